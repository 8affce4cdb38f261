"""Byte-level pair encoding with a rank queue over a hierarchical bitmap, for pre-tokens of any length.

A pre-token is a chain of byte runs. A run's adjacent pair has the rank of its joined bytes. The queue
has one bucket per rank with the places of the pairs of that rank, and a bitmap of the buckets in use with
a bitmap of its words above it: two find-first-set steps give the lowest rank. A bucket is served
from left to right; a place whose pair has changed since it was queued is stale and skipped (a pair
only ever grows, so it never comes back to a rank). When a merge makes a pair of a lower rank than the
bucket's, the pre-token's other places of the bucket wait. So each merge costs a few dictionary and
bitmap steps and one step in its bucket's heap, and a pre-token of n bytes O(n log n).

Text is cut at blanks that no pattern match can cross; each stretch is cut by the pattern, encoded once
and remembered, long ones excepted. Decoding joins the bytes of the ids.

Edge cases: null and empty texts have no tokens (digests of the empty string); strings that look like
special tokens are plain text; repeated rows and further columns of the input are kept as they are; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import accumulate

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WordCache, small_batches

BITS = 8                       # a bitmap word covers 256 buckets
ALONE = 256                    # bytes from which a pre-token has the queue to itself
SHARED = 1 << 18               # bytes of the shorter ones that share it
_LOW = (1 << BITS) - 1
# A blank with white space before it and after it (or the end): only then do stretches hang together.
_WIDE_GAP = re.compile(r"\s (?:\s|\Z)")
_CUT = re.compile(r"(?<=\S)(?= )")
_loaded: dict = {}


def _popped(heap: list[int]) -> Iterator[int]:
    while heap:
        yield heappop(heap)


class RankQueue:
    """Buckets of places by rank, and a two-level bitmap of the ranks in use."""

    def __init__(self, ranks: int):
        self.words = [0] * ((ranks >> BITS) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def mark(self, rank: int) -> None:
        """The rank has a bucket from now on."""
        word = rank >> BITS
        if not self.words[word]:
            self.top |= 1 << word
        self.words[word] |= 1 << (rank & _LOW)

    def take(self) -> tuple[int, list[int]]:
        """The lowest rank in use with its bucket, which leaves the queue."""
        top = self.top
        word = (top & -top).bit_length() - 1
        low = self.words[word]
        rank = word << BITS | (low & -low).bit_length() - 1
        low &= low - 1
        self.words[word] = low
        if not low:
            self.top = top & (top - 1)
        return rank, self.buckets.pop(rank)


class Encoder:
    """The ranks of a tiktoken file and the pattern that cuts text before the merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self._set_ranks({base64.b64decode(t): int(r) for t, r in pairs})
        self.cut = regex.compile(pattern).findall
        self.plain = r"| ?\p{L}+|" in pattern

    def _set_ranks(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.pair_rank = np.full(1 << 16, -1, np.int64)
        for t, r in ranks.items():
            if len(t) == 2:
                self.pair_rank[t[0] << 8 | t[1]] = r

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens: itself if it is a token, else the merges from single bytes. Short ones share
        a queue, in which none sees another's pairs; a long one has it to itself."""
        out: list = [None] * len(pieces)
        batch: list[int] = []
        size = 0
        for k, p in enumerate(pieces):
            rank = self.ranks.get(p)
            if rank is not None:
                out[k] = [rank]
            elif len(p) > ALONE:
                out[k] = self._merged([p])[0]
            else:
                batch.append(k)
                size += len(p)
                if size > SHARED:
                    for i, ids in zip(batch, self._merged([pieces[i] for i in batch])):
                        out[i] = ids
                    batch, size = [], 0
        for i, ids in zip(batch, self._merged([pieces[i] for i in batch])):
            out[i] = ids
        return out

    def _merged(self, pieces: list[bytes]) -> list[list[int]]:
        data = b"".join(pieces)
        n, alone = len(data), len(pieces) == 1
        if not n:
            return [[] for _ in pieces]
        edges = list(accumulate(map(len, pieces)))
        edge = bytearray(n + 1)                   # 1 where a piece ends
        before = list(range(-1, n))               # start of the run before the one that starts at a place
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        first = self.pair_rank[raw[:-1] << 8 | raw[1:]]
        for e in edges:
            edge[e] = 1
            before[e] = -1
        first[np.array(edges[:-1], np.int64) - 1] = -1
        pair = [*first.tolist(), -1]              # rank of the pair that starts at a place
        end = list(range(1, n + 1))               # end of the run that starts at a place
        get, queue = self.ranks.get, self.queue
        buckets, mark = queue.buckets, queue.mark
        push = heappush if alone else list.append    # a shared bucket is sorted when it is served
        places = np.flatnonzero(first >= 0)
        order = np.argsort(first[places], kind="stable")
        ranks, starts = np.unique(first[places][order], return_index=True)
        for rank, found in zip(ranks.tolist(), np.split(places[order], starts[1:])):
            buckets[rank] = found.tolist()
            mark(rank)
        while queue.top:
            rank, places = queue.take()
            waiting, blocked = [], -1
            if not alone:
                places.sort()
            for i in _popped(places) if alone else places:
                if pair[i] != rank:
                    continue
                if i < blocked:
                    waiting.append(i)
                    continue
                j = end[i]
                stop = end[j]
                end[i] = stop
                pair[j] = -1
                lowest = rank
                if edge[stop]:
                    pair[i] = -1
                else:
                    before[stop] = i
                    r = pair[i] = get(data[i:end[stop]], -1)
                    if r >= 0:
                        bucket = buckets.get(r)
                        if bucket is None:
                            buckets[r] = [i]
                            mark(r)
                        else:
                            push(bucket, i)
                        if r < lowest:
                            lowest = r
                h = before[i]
                if h >= 0:
                    r = pair[h] = get(data[h:stop], -1)
                    if r >= 0:
                        bucket = buckets.get(r)
                        if bucket is None:
                            buckets[r] = [h]
                            mark(r)
                        else:
                            push(bucket, h)
                        if r < lowest:
                            lowest = r
                if lowest < rank:                 # the piece's other places of this rank wait
                    if alone:
                        waiting = places
                        break
                    blocked = edges[bisect_right(edges, i)]
            if waiting:
                buckets[rank] = waiting
                mark(rank)
        ids, out, i = [], [], 0
        while i < n:
            stop = end[i]
            ids.append(self.ranks[data[i:stop]])
            if edge[stop]:
                out.append(ids)
                ids = []
            i = stop
        return out

    def stretches(self, text: str) -> list[str]:
        """The text in stretches that the pattern cuts apart from one another."""
        if _WIDE_GAP.search(text):
            return _CUT.split(text)
        first, *others = text.split(" ")
        return [first, *[" " + s for s in others]] if first else [" " + s for s in others]

    def encode(self, text: str) -> list[int]:
        found = [p.encode() for s in self.stretches(text) for p in self.cut(s)]
        different = list(set(found))
        ids = dict(zip(different, self.encode_pieces(different)))
        return [i for p in found for i in ids[p]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def encoder(path: str, pattern: str) -> Encoder:
    """One per process and file."""
    key = (path, pattern)
    if key not in _loaded:
        _loaded[key] = Encoder(path, pattern)
    return _loaded[key]


def digests(texts: Iterator[pd.Series], path: str, pattern: str) -> Iterator[pd.DataFrame]:
    enc = encoder(path, pattern)

    def written(ids: list[int]) -> tuple[str, int, bytes]:
        return ",".join(map(str, ids)), len(ids), enc.decode(ids)

    pieces = _loaded.setdefault(("pieces", path, pattern), WordCache(
        lambda found: [written(ids) for ids in enc.encode_pieces([p.encode() for p in found])]))

    def whole(found: list[str]) -> list[tuple[str, int, bytes]]:
        # letters, after a blank or not, are one match of the pattern if it takes them so
        cut = [(s,) if enc.plain and (s[1:] if s[0] == " " else s).isalpha() else enc.cut(s) for s in found]
        known = pieces.look_up({p for parts in cut for p in parts})
        out = []
        for parts in cut:
            if len(parts) == 1:
                out.append(known[parts[0]])
            else:
                ids, n, text = zip(*[known[p] for p in parts])
                out.append((",".join(ids), sum(n), b"".join(text)))
        return out

    cache = _loaded.setdefault(("stretches", path, pattern), WordCache(whole))
    for series in texts:
        split = [enc.stretches(t) if t else [] for t in series]
        known = cache.look_up({s for parts in split for s in parts})
        rows = []
        for parts in split:
            found = [known[s] for s in parts]
            rows.append((sum([f[1] for f in found]),
                         hashlib.sha256(",".join([f[0] for f in found]).encode()).hexdigest(),
                         hashlib.sha256(b"".join([f[2] for f in found])).hexdigest()))
        yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, for every whole text."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from digests(texts, path, pattern)

    return docs.select("doc_id", run(F.col("text")).alias("r")).select("doc_id", "r.*")


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The ids themselves: every column of ``docs`` and ``ids`` array<int>."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path, pattern)
        for s in texts:
            yield pd.Series([enc.encode(t) if t else [] for t in s])

    return docs.withColumn("ids", run(F.col("text")))


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Decode ``ids`` array<int> to ``decoded``, binary, as ids may end inside a character; null stays null."""
    @F.pandas_udf("binary")
    def run(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path, pattern)
        for s in lists:
            yield pd.Series([None if x is None else enc.decode(list(x)) for x in s])

    return encoded.withColumn("decoded", run(F.col("ids")))
