"""Subword lattice likelihood.

A document is a sequence of words, each written with the vocabulary's word mark in front, and one
end. The pieces of an existing subword vocabulary span a lattice over every word; the sum over all
segmentations of the product of piece probabilities is found by the forward recursion in log space.
Every training word is one more arc, over the whole word: of its c training tokens it keeps c - d, and
what all words give up, d each, is the weight of the arcs over pieces. d is the share that makes a word
seen once expect to be seen again as often as held-out text shows (absolute discounting from the
numbers of words seen once and twice). As no piece crosses a word mark, the document's marginal is the
product over its words and the end; probabilities of all texts sum to one.

The vocabulary's own scores rank its pieces; they give the starting weights (Zipf's law on the rank),
which a few rounds of expectation-maximisation fit to all training words and their counts. The expected
counts are sums over the corpus, made in Spark; only the piece table and at most FREQUENT words pass
through the driver. Characters outside the vocabulary are spelt in byte pieces.

Every distinct word is scored once. The FREQUENT words with the most training tokens travel with the
tasks, with their scores; all other words of a document are joined with the table of word scores by a
shuffle on the word. The unigram word model beside it takes the same way.

Edge cases: null and empty texts are the end alone; with no training rows the starting weights stay
and every token is unknown; repeated rows are scored each; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import small_batches, stored

MARK = "▁"
FREQUENT = 100_000         # words of the word table that are sent to every task
ROUNDS = 2                 # of expectation-maximisation
PSEUDO = 0.1               # added to every piece's expected count
_FLUSH = 400_000
_P = np.uint64(0x9E3779B97F4A7C15)
_process: dict = {}


class Pieces:
    """The vocabulary's strings with a hash table for substrings of a batch of words."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.get_piece_size())
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        spelt = [i for i in usable if not model.is_byte(i)]
        self.strings = [model.id_to_piece(i) for i in spelt]
        # the existing scores order the pieces; Zipf's law turns the order into weights
        rank = np.argsort(np.argsort([-model.get_score(i) for i in spelt], kind="stable"), kind="stable")
        self.n = len(self.strings)                       # then 256 byte pieces
        self.bytes_at, self.size = self.n, self.n + 256
        start = np.concatenate((1.0 / (rank + 10.0), np.full(256, 1e-7)))
        self.start = np.log(start / start.sum())
        self.longest = max(map(len, self.strings))
        width = np.array([len(s) for s in self.strings])
        code = np.zeros((self.n, self.longest), np.uint32)
        for k, s in enumerate(self.strings):
            code[k, :len(s)] = [ord(c) for c in s]
        h = self._prefix(code)
        key = np.array([h[k, w] for k, w in enumerate(width)], np.uint64) ^ width.astype(np.uint64)
        self.order = np.argsort(key)
        self.key = key[self.order]

    @staticmethod
    def _prefix(code: np.ndarray) -> np.ndarray:
        h = np.zeros((code.shape[0], code.shape[1] + 1), np.uint64)
        mixed = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        for k in range(code.shape[1]):
            h[:, k + 1] = h[:, k] * _P + mixed[:, k]
        return h

    def lattice(self, code: np.ndarray) -> np.ndarray:
        """ids[word, start, length-1] of the pieces over words of one width, -1 where there is none."""
        b, n = code.shape
        h, most = self._prefix(code), min(n, self.longest)
        ids = np.full((b, n, most), -1, np.int32)
        power = np.uint64(1)
        for length in range(1, most + 1):
            power = np.uint64((int(power) * int(_P)) & (2**64 - 1))
            key = (h[:, length:] - h[:, :n - length + 1] * power) ^ np.uint64(length)
            at = np.searchsorted(self.key, key)
            at[at == self.n] = 0
            ids[:, :n - length + 1, length - 1] = np.where(self.key[at] == key, self.order[at], -1)
        return ids


def pieces(path: str) -> Pieces:
    if path not in _process:
        _process[path] = Pieces(path)
    return _process[path]


def _groups(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Batches of marked words of one length: their places and code points."""
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w) + 1, []).append(k)
    for n, members in by_length.items():
        step = max(1, (1 << 16) // n)
        for a in range(0, len(members), step):
            part = members[a:a + step]
            raw = "".join(MARK + words[k] for k in part).encode("utf-32-le", "surrogatepass")
            yield part, np.frombuffer(raw, "<u4").reshape(len(part), n)


def _weights(code: np.ndarray, ids: np.ndarray, logp: np.ndarray, at: int) -> np.ndarray:
    """Log weights of the lattice's arcs; characters that are no piece are spelt in bytes."""
    w = np.where(ids >= 0, logp[np.maximum(ids, 0)], -np.inf)
    odd = ids[:, :, 0] < 0
    if odd.any():
        chars, back = np.unique(code[odd], return_inverse=True)
        spelt = [sum(logp[at + x] for x in chr(c).encode("utf-8", "surrogatepass")) for c in chars.tolist()]
        w[odd, 0] = np.array(spelt)[back]
    return w


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    top = np.where(np.isfinite(top), top, 0.0)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


def _forward(w: np.ndarray) -> np.ndarray:
    b, n, most = w.shape
    alpha = np.full((b, n + 1), -np.inf)
    alpha[:, 0] = 0.0
    for end in range(1, n + 1):
        k = min(end, most)
        starts = np.arange(end - 1, end - 1 - k, -1)
        alpha[:, end] = _log_sum(alpha[:, starts] + w[:, starts, np.arange(k)])
    return alpha


def log_marginals(words: list[str], table: Pieces, logp: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability over all segmentations."""
    out = np.zeros(len(words))
    for part, code in _groups(words):
        out[part] = _forward(_weights(code, table.lattice(code), logp, table.bytes_at))[:, -1]
    return out


def expected_counts(words: list[str], counts: np.ndarray, table: Pieces, logp: np.ndarray) -> np.ndarray:
    """Expected uses of every piece over all segmentations of the words, times the words' counts."""
    out = np.zeros(table.size)
    for part, code in _groups(words):
        ids = table.lattice(code)
        w = _weights(code, ids, logp, table.bytes_at)
        b, n, most = w.shape
        alpha = _forward(w)
        beta = np.full((b, n + 1), -np.inf)
        beta[:, n] = 0.0
        for start in range(n - 1, -1, -1):
            k = min(n - start, most)
            beta[:, start] = _log_sum(w[:, start, :k] + beta[:, start + 1:start + 1 + k])
        after = np.full((b, n, most), -np.inf)
        for length in range(1, most + 1):
            after[:, :n - length + 1, length - 1] = beta[:, length:]
        use = np.exp(alpha[:, :n, None] + w + after - alpha[:, n][:, None, None]) * counts[part][:, None, None]
        known = ids >= 0
        out[:table.n] += np.bincount(ids[known], use[known], table.n)
        odd = ids[:, :, 0] < 0
        for c, u in zip(code[odd].tolist(), use[:, :, 0][odd].tolist()):
            for x in chr(c).encode("utf-8", "surrogatepass"):
                out[table.bytes_at + x] += u
    return out


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.encode().lower().split() if text else []


def word_counts(docs: DataFrame, training: Column) -> DataFrame:
    """(word, c): every word of all documents with its count in the training documents."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()),
                                               pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return made

        for b in batches:
            learn: list[bytes] = []
            other: set[bytes] = set()
            for text, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    learn += tokens(text)
                else:
                    other.update(tokens(text))
            seen.update(learn)
            for w in other.difference(seen):
                seen[w] = 0
            if len(seen) > _FLUSH:
                yield out()
        yield out()

    return (docs.select("text", training.alias("t")).mapInArrow(count, "word string, c long")
            .groupBy("word").agg(F.sum("c").alias("c")))


def fit(words: DataFrame, path: str, rounds: int) -> np.ndarray:
    """Log probabilities of the pieces, from a table (word, c) of training counts."""
    size, logp = pieces(path).size, pieces(path).start
    learn = words.filter("c > 0").select("word", "c")
    for _ in range(rounds):
        def expect(batches: Iterator[pa.RecordBatch], logp=logp) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for b in batches:
                total += expected_counts(b.column(0).to_pylist(), b.column(1).to_numpy().astype(float), pieces(path), logp)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["piece", "n"])

        learn.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16384")
        rows = learn.mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        if rows.empty:
            break
        n = np.full(size, PSEUDO)
        n[rows["piece"].to_numpy(int)] += rows["n"].to_numpy(float)
        logp = np.log(n / n.sum())
    return logp


@dataclass(frozen=True)
class WordArcs:
    """Weights of the arcs over whole words beside those over pieces."""

    tokens: int         # training tokens that are words
    ends: int           # training documents
    kinds: int          # distinct training words
    once: int           # of these, seen once
    twice: int

    @property
    def discount(self) -> float:
        """Between 0 and 1: what every training word gives to the pieces."""
        return (self.once + 0.5) / (self.once + 2 * self.twice + 1)

    @property
    def log_end(self) -> float:
        return math.log((self.ends + 0.5) / (self.tokens + self.ends + 1))

    def log_word(self, marginal: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log probabilities of words, from those over pieces and the training counts."""
        going_on = math.log((self.tokens + 0.5) / (self.tokens + self.ends + 1))
        if not self.tokens:
            return going_on + marginal
        pieces_share = math.log(self.discount * self.kinds / self.tokens)
        with np.errstate(divide="ignore"):
            arc = np.log(np.maximum(counts - self.discount, 0) / self.tokens)
        return going_on + np.logaddexp(pieces_share + marginal, arc)


def frequent_words(words: DataFrame, most: int) -> list[tuple[str, int]]:
    """The words of the highest counts, ``most`` at most: whole classes of counts (eighths of a doubling),
    so that only the words taken and one line a class reach the driver."""
    level = F.floor(F.log2("c") * 8)
    classes = words.filter("c > 0").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    taken, least = 0, None
    for r in sorted(classes, key=lambda r: -r["level"]):
        taken += r["n"]
        if taken > most:
            break
        least = r["level"]
    if least is None:
        return []
    found = words.filter((F.col("c") > 0) & (level >= F.lit(least))).select("word", "c").collect()
    return sorted(((r["word"], r["c"]) for r in found), key=lambda x: (-x[1], x[0]))


def word_scores(words: DataFrame, path: str, logp: np.ndarray, arcs: WordArcs) -> DataFrame:
    """(word, c, score): every distinct word's log10 probability over all segmentations."""

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = arcs.log_word(log_marginals(b.column(0).to_pylist(), pieces(path), logp), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m / math.log(10))], names=["word", "c", "score"])

    words.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16384")
    return words.select("word", "c").mapInArrow(price, "word string, c long, score double")


def score(docs: DataFrame, training: Column, path: str, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """Every document's base score (add-half unigram words) and lattice score, both log10.

    ``training``: boolean column, true for the documents to learn from."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), training.alias("t"))
    words = stored(word_counts(docs, F.col("t")), "lattice-words")
    n_train, distinct, once, twice = words.agg(F.coalesce(F.sum("c"), F.lit(0)), *[
        F.count(F.when(cond, 1)) for cond in (F.col("c") > 0, F.col("c") == 1, F.col("c") == 2)]).first()
    ends = docs.filter("t").count()
    # the end is a token of the base model and counts as one of its words
    total, kinds = int(n_train) + ends, int(distinct) + (1 if ends else 0)
    listed = frequent_words(words, frequent)
    top = {w.encode(): c for w, c in listed}
    arcs = WordArcs(int(n_train), ends, int(distinct), int(once), int(twice))
    logp = fit(words, path, rounds)
    floor = math.log10(total + 0.5 * (kinds + 1))
    end_base = math.log10(ends + 0.5) - floor
    end_score = arcs.log_end / math.log(10)
    priced = stored(word_scores(words, path, logp, arcs), "lattice-priced")
    whole = arcs.log_word(log_marginals([w for w, _ in listed], pieces(path), logp), np.array([c for _, c in listed], float))
    frequent_score = dict(zip(top, (whole / math.log(10)).tolist()))
    frequent_base = {w: math.log10(c + 0.5) - floor for w, c in top.items()}
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, known long, base double, score double, rare array<string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            rows = []
            for text in s:
                ws = tokens(text)
                found = [w for w in ws if w in frequent_score]
                rare = [w.decode() for w in ws if w not in frequent_score] if len(found) < len(ws) else []
                rows.append((len(ws) + 1, len(found) + (1 if ends else 0),
                             math.fsum([frequent_base[w] for w in found]) + end_base,
                             math.fsum([frequent_score[w] for w in found]) + end_score, rare))
            yield pd.DataFrame(rows, columns=["n_tokens", "known", "base", "score", "rare"])

    scored = docs.select("doc_id", "t", run(F.col("text")).alias("r")).select("doc_id", "t", "r.*")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "lattice-scored")
    rare = (scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("k"))
            .join(priced, "word")
            .groupBy("row").agg(F.sum(F.col("k") * F.col("score")).alias("rare_score"),
                                F.sum(F.col("k") * (F.log10(F.col("c") + 0.5) - F.lit(floor))).alias("rare_base"),
                                F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("rare_known")))
    return scored.join(rare, "row", "left").select(
        "doc_id", (~F.col("t")).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"))
