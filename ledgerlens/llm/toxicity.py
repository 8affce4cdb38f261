"""Toxicity by a weighted finite-state pattern grammar.

Texts are read clause by clause. Five small transducers are composed into one table: INSULT and
THREAT emit a word's weight; TARGET (a person is addressed nearby) multiplies it; NEGATION and
REPORTED SPEECH damp it. What is scored is the matched clause, from its own start state, never a
word by itself.

The function words are fixed lists; the insult words and insult stems (word beginnings) of all
languages are learnt from labelled rows: those that are much more frequent in toxic documents and
appear there in several surroundings, so that a passage which was copied many times teaches nothing.
Learning reads at most SAMPLE labelled rows (those with the smallest hash), the documented bound of
this classifier; LEARN_PART of it learn the words, the rest turn the clause evidence into a
probability. A score uses the text alone.

Edge cases: null and empty texts have no clause and get the probability of no evidence; without
labelled rows only the fixed words count; conflicting labels of a document count as toxic; null
labels are not learnt from; repeated rows are scored each; further columns are kept by ``keep_clean``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WordCache, held_out, small_batches

SAMPLE = 20_000
LEARN_PART = 0.75
THRESHOLD = 0.3
LEAST_WEIGHT = 2.5         # log ratio of a learnt word's shares in toxic and other documents
LEAST_SURROUNDINGS = 3     # different left neighbours (for stems: neighbour and word) in toxic documents
STEMS = (4, 5, 6, 7, 8)
MAX_LEARNT = 100_000       # checked bound of the learnt list that tasks receive

# Classes of words. Fixed lists of English function words and threat verbs.
THREATS = "kill hurt destroy beat murder shoot stab burn attack smash".split()
TARGETS = "you your yours you're u ur he him his she her they them their people everyone".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't nobody without hardly".split()
REPORTS = "said says saying told wrote writes claimed claims reported reports quoted quotes according alleged".split()
SEED_INSULTS = "idiot moron stupid scum worthless pathetic loser disgusting trash".split()
PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:,\n]+")


def transducer(states: int, step, gain) -> tuple[np.ndarray, np.ndarray]:
    """(next state, weight multiplier) tables of [state, class]."""
    move = np.array([[step(s, c) for c in range(6)] for s in range(states)])
    factor = np.array([[gain(s, c) for c in range(6)] for s in range(states)], float)
    return move, factor


def compose(first, second) -> tuple[np.ndarray, np.ndarray]:
    """Both at once: states are pairs, multipliers multiply."""
    (m1, f1), (m2, f2) = first, second
    n2 = len(m2)
    move = (m1[:, None, :] * n2 + m2[None, :, :]).reshape(-1, m1.shape[1])
    return move, (f1[:, None, :] * f2[None, :, :]).reshape(-1, f1.shape[1])


def grammar() -> tuple[list, list]:
    """The composed table; state 0 is a clause's start."""
    emits = (INSULT, THREAT)
    insult = transducer(1, lambda s, c: 0, lambda s, c: 1.0 if c == INSULT else 0.0 if c != THREAT else 1.0)
    threat = transducer(1, lambda s, c: 0, lambda s, c: 0.5 if c == THREAT else 1.0)     # alone, half an insult
    target = transducer(5, lambda s, c: 4 if c == TARGET else max(0, s - 1),
                        lambda s, c: 2.0 if s and c == THREAT else 1.25 if s and c in emits else 1.0)
    negation = transducer(4, lambda s, c: 3 if c == NEGATION else max(0, s - 1),
                          lambda s, c: 0.25 if s and c in emits else 1.0)
    report = transducer(2, lambda s, c: 1 if c == REPORT else s, lambda s, c: 0.5 if s and c in emits else 1.0)
    table = insult
    for t in (threat, target, negation, report):
        table = compose(table, t)
    return table[0].tolist(), table[1].tolist()


MOVE, FACTOR = grammar()


def clause_score(classes: list[tuple[int, float]]) -> float:
    """The weight that the grammar gives one clause, read as (class, weight) of its words."""
    state, score = 0, 0.0
    for c, w in classes:
        if w:
            score += w * FACTOR[state][c]
        state = MOVE[state][c]
    return score


class Lexicon:
    """Word -> (class, weight)."""

    def __init__(self, learnt: dict[str, float]):
        self.fixed: dict[str, tuple[int, float]] = {}
        for words, kind, weight in ((THREATS, THREAT, 2.0), (TARGETS, TARGET, 0.0), (NEGATIONS, NEGATION, 0.0),
                                    (REPORTS, REPORT, 0.0), (SEED_INSULTS, INSULT, 2.0)):
            self.fixed |= {w: (kind, weight) for w in words}
        self.words = {w: x for w, x in learnt.items() if not w.endswith("*")}
        self.stems = {w[:-1]: x for w, x in learnt.items() if w.endswith("*")}

    def of(self, word: str) -> tuple[int, float]:
        weight = max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n)])
        kind, fixed = self.fixed.get(word, (PLAIN, 0.0))
        if kind in (TARGET, NEGATION, REPORT):
            return kind, 0.0
        return (kind if kind else INSULT, max(fixed, weight)) if fixed or weight else (PLAIN, 0.0)


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def evidence(text: str | None, lexicon: Lexicon, matched: float = 1.0) -> tuple[float, int]:
    """(sum of the scores of the matched clauses, their number)."""
    total, many = 0.0, 0
    for clause in CLAUSE.split(text.lower()) if text else ():
        s = clause_score([lexicon.of(w) for w in WORD.findall(clause)])
        if s >= matched:
            total, many = total + s, many + 1
    return total, many


def _sample(docs: DataFrame, labels: DataFrame, held: Column) -> DataFrame:
    """(text, toxic, learns) of the bounded sample. The sample's ids and labels are broadcast: SAMPLE rows at most."""
    rows = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held)
            .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
            .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(SAMPLE)
            .withColumn("learns", F.pmod(F.xxhash64("h"), F.lit(100)) < int(100 * LEARN_PART)))
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", "toxic", "learns").filter("text is not null")


def learn_words(sample: DataFrame) -> dict[str, float]:
    """Insult words and stems (ending in *) with their weights."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, neg, around = Counter(), Counter(), set()
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = WORD.findall(text.lower())
                seen = {f for w in set(words) for f in features(w)}
                (pos if toxic else neg).update(seen)
                if toxic:
                    for left, w in zip(["", *words], words):
                        around.update((f, hash_of(left + " " + w) if f[-1] == "*" else hash_of(left)) for f in features(w))
            rows = [(f, None, pos[f], neg[f]) for f in {*pos, *neg}] + [(f, h, 0, 0) for f, h in around]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
                                              pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                                             names=["f", "h", "pos", "neg"])

    learn = sample.filter("learns").select("text", "toxic")
    n_pos, n_all = learn.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    n_neg = n_all - n_pos
    if not n_pos or not n_neg:
        return {}
    ratio = F.log((F.col("pos") + 0.5) / F.lit(n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(n_neg + 1.0))
    found = (learn.mapInArrow(count, "f string, h long, pos long, neg long")
             .groupBy("f", "h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
             .groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count("h").alias("around"))
             .withColumn("w", ratio)
             .filter((F.col("w") >= LEAST_WEIGHT) & (F.col("pos") >= LEAST_SURROUNDINGS)
                     & (F.col("around") >= LEAST_SURROUNDINGS))
             .select("f", "w").limit(MAX_LEARNT + 1).collect())
    if len(found) > MAX_LEARNT:
        raise ValueError(f"more than {MAX_LEARNT} learnt words; raise LEAST_SURROUNDINGS")
    return {r["f"]: float(r["w"]) for r in found}


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) >> 1


def _bin(total: float, many: int) -> int:
    """Bins of evidence, in its order: none, then half-doublings."""
    return 0 if not many else 1 + min(20, int(2 * math.log2(max(total, 1.0))))


def _evidence_of(frame: DataFrame, learnt: dict[str, float]) -> DataFrame:
    """``frame`` with e: struct of total, clauses and bin."""
    @F.pandas_udf("total double, clauses int, bin int")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(learnt)

        def hot(some: list[str]) -> list[bool]:
            return [any(lexicon.of(w)[1] for w in WORD.findall(t.lower())) for t in some]

        cache = WordCache(hot)
        for s in texts:
            split = [t.split() if t else [] for t in s]
            known = cache.look_up({w for ws in split for w in ws})
            rows = []
            for t, ws in zip(s, split):
                # a text without any weighted word has no clause that matches
                total, many = evidence(t, lexicon) if True in [known[w] for w in ws] else (0.0, 0)
                rows.append((total, many, _bin(total, many)))
            yield pd.DataFrame(rows, columns=["total", "clauses", "bin"])

    return frame.withColumn("e", run(F.col("text")))


def calibrate(sample: DataFrame, learnt: dict[str, float]) -> list[float]:
    """Probability of toxic by bin of evidence, rising: pooled adjacent bins (isotonic regression)."""
    rows = (_evidence_of(sample.filter(~F.col("learns")).select("text", "toxic"), learnt)
            .groupBy("e.bin").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n")).collect())
    n = {r["bin"]: (r["pos"], r["n"]) for r in rows}
    base = sum(p for p, _ in n.values()) / max(1, sum(k for _, k in n.values()))
    blocks: list[list[float]] = []
    for b in range(22):
        pos, many = n.get(b, (0, 0))
        prior = min(base, 0.05) if b == 0 else 0.5      # a matched clause speaks for toxic unless labels say otherwise
        blocks.append([pos + prior, many + 1.0, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            pos, many, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + pos, blocks[-1][1] + many, blocks[-1][2] + k]
    return [p / k for p, k, m in blocks for _ in range(m)]


def fit(docs: DataFrame, labels: DataFrame, held: Column) -> tuple[dict[str, float], list[float]]:
    small_batches(docs.sparkSession)
    sample = _sample(docs, labels, held)
    learnt = learn_words(sample)
    return learnt, calibrate(sample, learnt)


def with_score(frame: DataFrame, learnt: dict[str, float], by_bin: list[float]) -> DataFrame:
    """``frame`` with score (0 to 1), clauses and evidence."""
    small_batches(frame.sparkSession)
    levels = F.array(*[F.lit(float(p)) for p in by_bin])
    return (_evidence_of(frame, learnt).withColumn("score", F.element_at(levels, F.col("e.bin") + 1))
            .withColumn("clauses", F.col("e.clauses")).withColumn("evidence", F.col("e.total")).drop("e"))


def score(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted, clauses, evidence of every document."""
    learnt, by_bin = fit(docs, labels, held_out(modulus, remainder))
    out = with_score(docs.select("doc_id", "text", held_out(modulus, remainder).alias("held_out")), learnt, by_bin)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                      "clauses", "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, columns unchanged."""
    columns = docs.columns
    learnt, by_bin = fit(docs, labels, held_out(modulus, remainder))
    text = docs.withColumn("_keep", F.struct(*columns)).select("_keep", "text")
    return with_score(text, learnt, by_bin).filter(F.col("score") < THRESHOLD).select("_keep.*")
