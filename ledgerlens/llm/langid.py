"""Language identification as mixture inference.

Each language is a distribution over hashed three-byte n-grams of lower-cased text, counted over all
learning documents. A document's words are drawn from an unknown mixture of the languages:
expectation-maximisation estimates the proportions from the words' likelihoods, and the language set
is the one, among the sets of the k largest proportions, whose likelihood less a penalty of
half the log of the word count for each further language is highest. The prediction is the set's
largest share and the score is that share.

Edge cases: null texts and texts without a letter are ``und`` with score 0; rows without a language
are not learnt from; if none can be learnt from, every text is ``und``; equal shares go to the name
first in order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import small_batches

BUCKETS = 1 << 16
PSEUDO = 0.5
ROUNDS = 20
TOLERANCE = 1e-3
UNKNOWN = "und"
MAX_LANGUAGES = 512        # bounds the model: BUCKETS x languages counts
HELD_LANGUAGES = 64        # languages a counting task holds at once, BUCKETS counts each
CELLS = 1 << 24            # n-grams x languages looked up at once; texts are taken together up to this


def _grams(raw: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes that end at each byte; ``raw`` starts with two blanks."""
    x = raw.astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def count_grams(docs: DataFrame, learn: Column) -> DataFrame:
    """(lang, bucket, n) over all documents to learn from."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list[bytes]] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(_bytes(text))
            for lang, texts in by.items():
                raw = np.frombuffer(b"  " + b"  ".join(texts), np.uint8)
                total[lang] = total.get(lang, 0) + np.bincount(_grams(raw), minlength=BUCKETS)
            if len(total) > HELD_LANGUAGES:
                yield from flush(total)
                total = {}
        yield from flush(total)

    def flush(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int64()),
                                              pa.array(n[used], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "text", F.col("lang").cast("string"))
    return rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, learn: Column) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log probability of each bucket under each of them."""
    # told before the texts are read: a column with any number of values must not be gathered
    named = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang").distinct()
    if named.limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = count_grams(docs, learn).toPandas()
    langs = sorted(counts["lang"].unique())
    n = np.full((BUCKETS, len(langs)), PSEUDO)
    at = {lang: k for k, lang in enumerate(langs)}
    n[counts["bucket"].to_numpy(int), counts["lang"].map(at).to_numpy(int)] += counts["n"].to_numpy(float)
    return langs, np.log(n / n.sum(0)).astype(np.float32)


def _mixture_round(like: np.ndarray, doc: np.ndarray, first: np.ndarray, share: np.ndarray):
    """One round over words: new shares of each document, and the log likelihood under the old ones."""
    x = like + np.log(np.maximum(share, 1e-12)).astype(np.float32)[doc]
    top = x.max(1, keepdims=True)
    e = np.exp(x - top)
    s = e.sum(1, keepdims=True)
    size = np.diff(np.append(first, len(doc)))[:, None]
    return np.add.reduceat(e / s, first, axis=0) / size, np.add.reduceat((np.log(s) + top)[:, 0], first, dtype=np.float64)


def _word_likelihoods(grams: np.ndarray, start: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """[word, language]: the sum of the log probabilities of each word's n-grams, CELLS of them at once."""
    step = max(1, CELLS // max(1, logp.shape[1]))
    bounds = np.append(start, len(grams))
    out = np.zeros((len(start), logp.shape[1]), np.float32)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + step, side="right")) - 1)
        if bounds[b] - bounds[a] <= step:
            out[a:b] = np.add.reduceat(logp[grams[bounds[a]:bounds[b]]], bounds[a:b] - bounds[a], axis=0)
        else:                                  # one word longer than a slice
            for c in range(bounds[a], bounds[b], step):
                out[a] += logp[grams[c:min(c + step, bounds[b])]].sum(0)
        a = b
    return out


def _together(texts: list[str], languages: int) -> Iterator[tuple[int, int]]:
    """Runs of texts whose characters times languages stay within CELLS (one text at least)."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        size = (len(t) + 2) * max(1, languages)
        if i > a and held + size > CELLS:
            yield a, i
            a, held = i, 0
        held += size
    if texts:
        yield a, len(texts)


def infer(texts: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the selected languages of each text, and the selected sets (both [text, language])."""
    k = logp.shape[1]
    raws = [_bytes(t) for t in texts]
    raw = np.frombuffer(b"  " + b"  ".join(raws) + b" ", np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    start = np.flatnonzero(~blank[2:] & blank[1:-1])          # of words, as places of n-grams
    like = _word_likelihoods(_grams(raw), start, logp)         # [word, language]; a blank belongs to the word before
    begins = np.cumsum([0, *(len(r) + 2 for r in raws[:-1])])
    doc = np.searchsorted(begins, start, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(texts)))
    share = np.full((len(texts), k), 1.0 / k)
    total = np.zeros(len(texts))

    def words_of(which):
        keep = np.zeros(len(texts), bool)
        keep[which] = True
        rows = keep[doc]
        renumber = np.cumsum(keep) - 1
        d = renumber[doc[rows]]
        return like[rows], d, np.searchsorted(d, np.arange(len(which)))

    open_, part = np.arange(len(texts)), (like, doc, first)
    for _ in range(ROUNDS):
        new, total[open_] = _mixture_round(*part, share[open_])
        moved = np.abs(new - share[open_]).max(1) > TOLERANCE
        share[open_] = new
        if not moved.any():
            break
        if not moved.all():
            open_ = open_[moved]
            part = words_of(open_)
    # nested sets of the largest shares; the likelihood of each under its own renormalised shares
    order = np.argsort(-share, axis=1, kind="stable")
    n_words = np.diff(np.append(first, len(doc)))
    best = np.take_along_axis(share, order[:, :1], 1)[:, 0]
    chosen = np.zeros(share.shape, bool)
    np.put_along_axis(chosen, order[:, :1], True, 1)
    mixed = np.flatnonzero(best < 1 - 0.5 / np.maximum(n_words, 1))
    if len(mixed) and k > 1:
        x, d, f = words_of(mixed)
        value, size = np.full(len(mixed), -np.inf), np.ones(len(mixed), int)
        for many in range(1, k + 1):
            inside = np.zeros((len(mixed), k), bool)
            np.put_along_axis(inside, order[mixed, :many], True, 1)
            s = np.where(inside, share[mixed], 0)
            s /= s.sum(1, keepdims=True)
            s, _ = _mixture_round(x, d, f, s)
            _, log_like = _mixture_round(x, d, f, s)
            gain = log_like - 0.5 * many * np.log(np.maximum(n_words[mixed], 2))
            better = gain > value
            value[better], size[better] = gain[better], many
        for r, many in zip(mixed, size):
            chosen[r, order[r, :many]] = True
    share = np.where(chosen, share, 0)
    return share / share.sum(1, keepdims=True), chosen


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """``docs`` with r: struct of lang_pred, score and languages (the set with its shares)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, languages string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            out = [(UNKNOWN, 0.0, "")] * len(s)
            able = [i for i, t in enumerate(s) if langs and has_letter(t)]
            some = [s.iloc[i] for i in able]
            for a, b in _together(some, len(langs)):
                share, chosen = infer(some[a:b], logp)
                for i, p, c in zip(able[a:b], share, chosen):
                    best = int(p.argmax())
                    names = ",".join(f"{langs[j]}:{p[j]:.3f}" for j in np.argsort(-p, kind="stable") if c[j])
                    out[i] = (langs[best], float(min(1.0, p[best])), names)
            yield pd.DataFrame(out, columns=["lang_pred", "score", "languages"])

    return docs.withColumn("r", run(F.col("text")))


def identify(docs: DataFrame, held: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages; learns from the documents that are not held out."""
    langs, logp = fit(docs, ~held)
    return predict(docs.select("doc_id", "text", held.alias("held_out")), langs, logp).select("doc_id", "held_out", "r.*")


def keep_known(docs: DataFrame, held: Column, least: float = 0.25) -> DataFrame:
    """Rows of ``docs`` whose language is known with at least ``least`` of the words; columns unchanged."""
    columns = docs.columns
    langs, logp = fit(docs, ~held)
    marked = predict(docs, langs, logp)
    return marked.filter((F.col("r.lang_pred") != UNKNOWN) & (F.col("r.score") >= least)).select(*columns)
