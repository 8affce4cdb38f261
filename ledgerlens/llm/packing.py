"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens. A window is WINDOW_SEQUENCES sequences; each queue is due its
target proportion of every window, and what rounding leaves over or takes in advance is its deficit,
carried into the next window. With a quantum of one token the scheduler serves, at every step, the
queue whose next token is the earliest due: token k of a queue with weight w is due at (2k+1)/(2w).
So the state after n tokens is known without playing the steps before it: each queue has served the
tokens due by a common time, corrected one by one until the sum is n (`served_after`). A partition
starts any window with the exact deficits it would have inherited, no task waits for another, and a
hot source is cut over as many tasks as its rows need.

Within a window each queue's tokens lie together, in the queues' order. The tail that fills no whole
sequence is laid out in sequences whose lengths are powers of two, so nothing is padded.

Edge cases: null and empty texts are the end token alone; a null source is a queue of its own;
repeated rows are packed once each; an empty table gives no pieces; other columns are not looked at.
Every source is its own queue at any number; their names and totals pass through the driver to every task.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.bpe import byte_symbols
from ledgerlens.llm.common import WordCache, small_batches, stored

SEQUENCE = 4096
WINDOW_SEQUENCES = 32
END_ID = 2
BOUND_CELLS = 1 << 24      # queue positions at window bounds that a task remembers
ROWS_PER_BUCKET = 4096     # rows that one ordering task partition holds on average
_process: dict = {}

PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
                "offset long, source string, window_id long")


class _Words:
    """Ids of white-space separated words, as bytes of ``kind``.

    The tokenizer lower-cases a word and cuts it into letters, digits and symbols; most words are letters
    and at most a few stops. Their lower-cased letters go straight to its merges, once for all forms of
    a word, without a pass of the whole tool each. Which letters this holds for is tried out on the
    tokenizer; all other words go through the tool."""

    LATIN_END = 0x250
    STOPS = ".,;:!?"
    TOOL = "\0"

    def __init__(self, tool):
        self.tool, self.merges = tool, tool.model
        wide = tool.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind = np.dtype(np.uint32 if wide else np.uint16)
        self.code = "I" if wide else "H"
        self.symbols = byte_symbols()
        letters = [c for c in map(chr, range(self.LATIN_END)) if c.isalpha() and self._agrees(c)]
        word = "".join(letters)
        self.simple = re.compile(f"([{word}]+)([{self.STOPS}]*)").fullmatch if letters and self._agrees(word) else None
        self.parts = WordCache(self._part_ids, 300_000)

    def _agrees(self, word: str) -> bool:
        try:
            tool = self.tool.encode(word + self.STOPS, add_special_tokens=False).ids
            stops = self.tool.encode(self.STOPS, add_special_tokens=False).ids
            return self._letters(word.lower()) + stops == tool
        except Exception:  # noqa: BLE001 - merges that don't know such symbols: the tool does all the work
            return False

    def _letters(self, letters: str) -> list[int]:
        if not letters.isascii():
            letters = "".join([self.symbols[b] for b in letters.encode()])
        return [t.id for t in self.merges.tokenize(letters)]

    def _part_ids(self, parts: list[str]) -> list[bytes]:
        """Ids of lower-cased letters by the merges, and of any word after TOOL by the whole tool."""
        code, letters = self.code, self._letters
        out = [None if p[0] == self.TOOL else array(code, letters(p)).tobytes() for p in parts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        if rest:
            found = self.tool.encode_batch_fast([parts[k][1:] for k in rest], add_special_tokens=False)
            for k, e in zip(rest, found):
                out[k] = array(code, e.ids).tobytes()
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        cut, parts, simple, by_tool = [], set(), self.simple, self.TOOL
        for w in words:
            w = w.decode()
            m = simple(w) if simple else None
            if m is None:
                first, stops = by_tool + w, ""
            else:
                first, stops = m.groups()
                first = first.lower()
                if stops:
                    stops = by_tool + stops
                    parts.add(stops)
            parts.add(first)
            cut.append((first, stops))
        known = self.parts.look_up(parts)
        return [known[a] + known[b] if b else known[a] for a, b in cut]


def _tokenizer(path: str):
    if path not in _process:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        words = _Words(Tokenizer.from_file(path))
        _process[path] = (WordCache(words.encode, 300_000), words.kind)
    return _process[path]


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, ids (binary, 2 or 4 bytes an id, end token included), n_tokens.

    White space separates tokens and is dropped, so a text's ids are those of its words in turn."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("ids binary, n_tokens long")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache, kind = _tokenizer(path)
        end, size = np.array([END_ID], kind).tobytes(), kind.itemsize
        for s in texts:
            split = [t.encode().split() if t else [] for t in s]
            known = cache.look_up({w for words in split for w in words})
            ids = [b"".join([known[w] for w in words]) + end for words in split]
            yield pd.DataFrame({"ids": ids, "n_tokens": [len(b) // size for b in ids]})

    return docs.select("doc_id", "source", run(F.col("text")).alias("r")).select("doc_id", "source", "r.*")


def served_after(n: int, totals: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Tokens each queue has served when ``n`` are served in all: deficit round-robin, quantum one.

    Ties go to the earlier queue. A queue that is used up leaves the others its turn."""
    n = min(n, int(totals.sum()))

    def due_by(v):
        k = np.floor(v * weights + 0.5)
        return np.minimum(totals, k.astype(np.int64))

    # each queue is within half a token of its share, so the time lies here, if no queue is used up by then
    queues, share = len(totals), float(weights.sum()) or 1.0
    low, high = max(0.0, (n - queues / 2 - 1) / share), (n + queues) / share
    if due_by(high).sum() < n:
        high = float((totals / weights).max(initial=0)) + 1.0
    for _ in range(80):
        if due_by(high).sum() - due_by(low).sum() <= 2 * queues:
            break
        mid = (low + high) / 2
        low, high = (mid, high) if due_by(mid).sum() < n else (low, mid)
    served = np.maximum(due_by(low) - 1, 0)      # one back: the last ones are taken in exact order below
    key = lambda s: ((2 * int(served[s]) + 1) / (2 * float(weights[s])), s)
    heap = [key(s) for s in range(len(totals)) if served[s] < totals[s]]
    heapq.heapify(heap)
    for _ in range(n - int(served.sum())):
        s = heapq.heappop(heap)[1]
        served[s] += 1
        if served[s] < totals[s]:
            heapq.heappush(heap, key(s))
    return served


def deficits(n: int, totals: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What each queue is still due of its target after ``n`` tokens (negative: served in advance)."""
    return n * weights / weights.sum() - served_after(n, totals, weights)


def tail_lengths(n: int) -> list[int]:
    """The powers of two that make up ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Layout:
    """Where the tokens of each queue go; the same in every task."""

    def __init__(self, totals: list[int], weights: list[float], sequence: int, window_sequences: int):
        self.totals = np.array(totals, np.int64)
        self.weights = np.array(weights, float)
        self.sequence, self.window = sequence, sequence * window_sequences
        self.all = int(self.totals.sum())
        self.whole = self.all // sequence
        self.tail, at = [], self.whole * sequence
        for k, size in enumerate(tail_lengths(self.all - at)):
            self.tail.append((at, self.whole + k, size))
            at += size
        self.bounds: dict[int, np.ndarray] = {}

    def bound(self, w: int) -> np.ndarray:
        if w not in self.bounds:
            if len(self.bounds) >= max(2, min(4096, BOUND_CELLS // max(1, len(self.totals)))):
                self.bounds.clear()
            self.bounds[w] = served_after(w * self.window, self.totals, self.weights)
        return self.bounds[w]

    def window_of(self, queue: int, token: int) -> int:
        low, high = 0, -(-self.all // self.window)
        guess = min(high - 1, int(token / max(1, int(self.totals[queue])) * high))
        if self.bound(guess)[queue] <= token < self.bound(guess + 1)[queue]:
            return guess
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.bound(mid)[queue] <= token else (low, mid)
        return low

    def place(self, position: int) -> tuple[int, int, int]:
        """(sequence, offset, room there) of a position in the whole layout."""
        if position < self.whole * self.sequence:
            o = position % self.sequence
            return position // self.sequence, o, self.sequence - o
        at, seq, size = next(t for t in reversed(self.tail) if t[0] <= position)
        return seq, position - at, at + size - position

    def pieces(self, queue: int, first: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(start, length, sequence, offset, window) of the pieces of a document that starts at
        token ``first`` of its queue."""
        done, w = 0, self.window_of(queue, first) if length else 0
        while done < length:
            lo, hi = self.bound(w), self.bound(w + 1)
            in_window = min(length - done, int(hi[queue]) - first - done)
            if in_window <= 0:
                w += 1
                continue
            position = w * self.window + int((hi[:queue] - lo[:queue]).sum()) + first + done - int(lo[queue])
            while in_window:
                seq, offset, room = self.place(position)
                size = min(room, in_window)
                yield done, size, seq, offset, w
                done, position, in_window = done + size, position + size, in_window - size


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES,
         target: dict | None = None) -> DataFrame:
    """Pieces of all documents. ``target`` gives the queues' proportions by source (missing ones get
    the least of them); by default each source's share of all tokens, so all queues end together."""
    spark = docs.sparkSession
    queue = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))
    ids = tokenized(docs.select("doc_id", "text", "source"), path)
    ids = ids.withColumn("queue", queue).withColumn("spread", F.xxhash64("doc_id", "ids"))
    ids = stored(ids, "packing-ids")

    by_queue = {r["queue"]: (int(r["n"]), int(r["rows"])) for r in ids.groupBy("queue").agg(
        F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    if not by_queue:
        return spark.createDataFrame([], PIECE_SCHEMA)
    names = sorted(by_queue)
    totals = [by_queue[q][0] for q in names]
    if target:
        least = min(target.values())
        if least <= 0:
            raise ValueError("target proportions must be positive")
        weights = [float(target.get(q[1:] if q.startswith("s") else None, least)) for q in names]
    else:
        weights = [float(t) for t in totals]
    number = {q: i for i, q in enumerate(names)}

    # each queue in order of (bucket, doc_id): a hot queue has as many buckets as its rows need
    buckets = max(64, -(-sum(r for _, r in by_queue.values()) // ROWS_PER_BUCKET))
    ids = ids.withColumn("bucket", F.pmod(F.col("spread"), F.lit(buckets)))
    starts = (ids.groupBy("queue", "bucket").agg(F.sum("n_tokens").alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(
                  Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)),
                  F.lit(0))).select("queue", "bucket", "before"))
    inside = Window.partitionBy("bucket", "queue").orderBy("doc_id", "ids").rowsBetween(Window.unboundedPreceding, -1)
    placed = (ids.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
              .join(starts, ["queue", "bucket"])
              .select("doc_id", "source", "queue", "ids", "n_tokens", (F.col("before") + F.col("within")).alias("first")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _tokenizer(path)[1]
        layout = Layout(totals, weights, sequence, window_sequences)
        fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window_id"]
        types = [pa.int64()] * 7 + [pa.string(), pa.int64()]
        for b in batches:
            rows = []
            for doc, source, q, raw, n, first in zip(*(b.column(c).to_pylist() for c in (
                    "doc_id", "source", "queue", "ids", "n_tokens", "first"))):
                wide = np.frombuffer(raw, kind).astype("<u4").tobytes()
                for start, length, seq, offset, w in layout.pieces(number[q], first, n):
                    rows.append((doc, start, length, zlib.crc32(wide[4 * start:4 * (start + length)]), n, seq, offset,
                                 source, w))
            cols = list(zip(*rows)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=fields)

    return placed.mapInArrow(cut, PIECE_SCHEMA)
