"""Rule bitmask ledger for text quality, in DataFrame functions only.

Every rule is evaluated once per document into a bit of ``fail_mask``, beside the measurements it
used. A policy is a version and a set of rules: applying one, or comparing what many of them would
reject, is bit arithmetic on the ledger and never reads a text again.

Edge cases: null and empty texts and texts without a word have all measurements zero and fail
``few_words``; other columns are not looked at; repeated rows are judged each; two different windows
count as equal when their 64-bit hashes do (of 20,000 words: once in 10^11 texts).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import SEPARATORS

WINDOW = 5
_SPLIT = r"[\x20\x09-\x0D]+"

# rule -> condition on the measurements; a rule's bit is its place. Conditions are in whole numbers.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "shouting": "10 * n_upper > 6 * word_chars",
    "digits": "10 * n_digits > 3 * word_chars",
}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return mask_of(self.rules)


def mask_of(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


POLICIES = {1: Policy(1, BASE), 2: Policy(2, tuple(RULES))}
CURRENT = POLICIES[2]


def _length(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that are left when ``pattern`` is taken out."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every whole text."""
    blank = "".join(SEPARATORS)
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    df = df.withColumn("_trim", F.btrim("_text", F.lit(blank)))
    df = df.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>"))
                       .otherwise(F.split("_trim", _SPLIT)))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(blank)) != ""))
    df = df.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _length(F.col("_text"), "[^#*$%&|<>]+").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _length(F.col("_text"), "[^A-Z]+").alias("n_upper"),
        _length(F.col("_text"), "[^0-9]+").alias("n_digits"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hash"))
    # a window's hash is made of its words' hashes
    df = df.withColumn("_window", F.when(
        F.col("n_words") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1)),
                    lambda i: F.xxhash64(*[F.element_at("_hash", i + k) for k in range(WINDOW)]))))
    # only texts with an equal pair of windows need their places; these are sorted by hash
    df = df.withColumn("_by_hash", F.when(
        F.size(F.array_distinct("_window")) < F.size("_window"),
        F.array_sort(F.transform("_window", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda k, j: F.get(F.col("_by_hash"), k)["h"].eqNullSafe(F.get(F.col("_by_hash"), j)["h"])
    df = df.withColumn("_at", F.when(F.col("_by_hash").isNotNull(), F.array_sort(F.transform(
        F.filter("_by_hash", lambda x, k: same(k, k - 1) | same(k, k + 1)), lambda x: x["i"]))))
    # a repeated window covers its words up to the next repeated window's start
    covered = F.aggregate(
        F.transform("_at", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), k + 1) - i, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda s, x: s + x)
    return df.withColumn("n_repeat_words", F.when(F.col("_at").isNull(), F.lit(0).cast("long")).otherwise(covered)).drop(
        "_hash", "_window", "_by_hash", "_at")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``fail_mask``: bit k is set if the k-th rule fails."""
    bits = [F.when(F.expr(cond), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, cond in enumerate(RULES.values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measure(docs).withColumn("fail_mask", mask)


def fails(policy: Policy) -> Column:
    return F.col("fail_mask").bitwiseAND(F.lit(policy.mask)) != 0


def apply_policy(led: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The ledger with base_failed, kept and the policy's version."""
    base = F.col("fail_mask").bitwiseAND(F.lit(mask_of(BASE))) != 0
    return led.withColumn("base_failed", base).withColumn("kept", ~base & ~fails(policy)).withColumn(
        "policy_version", F.lit(policy.version))


def ablations(led: DataFrame, policies=None) -> DataFrame:
    """For each policy and rule: rows rejected, rows the rule fails, rows that only this rule rejects
    and so would be kept without it. One count by mask, then bits: the text is not read again."""
    policies = list((policies or POLICIES).values())
    by_mask = led.groupBy("fail_mask").agg(F.count(F.lit(1)).alias("n"))
    cases = [(p.version, rule, p.mask, mask_of([rule])) for p in policies for rule in p.rules]
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"),
                                        F.lit(b).cast("long").alias("bit")) for v, r, m, b in cases])).alias("c")
    hit = F.col("fail_mask").bitwiseAND(F.col("c.mask"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return by_mask.select("fail_mask", "n", each).groupBy("c.version", "c.rule").agg(
        n(hit != 0).alias("rejected"), n(F.col("fail_mask").bitwiseAND(F.col("c.bit")) != 0).alias("failed"),
        n(hit == F.col("c.bit")).alias("only_this"))


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT r, i, array_to_string(words[i:i+4], ' ') AS five
      FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
d AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt
      FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS k FROM g) WHERE k > 1),
c AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM d GROUP BY r),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper,
        length(regexp_replace(text, '[^0-9]+', '', 'g')) AS n_digits, coalesce(c.n, 0) AS n_repeat_words
      FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, @MASK@ AS fail_mask FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (fail_mask & @BASE@) <> 0 AS base_failed,
  (fail_mask & @ALL@) = 0 AS kept, CAST(fail_mask AS BIGINT) AS fail_mask
FROM f
""".replace("@MASK@", " + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, c in enumerate(RULES.values()))) \
    .replace("@BASE@", str(mask_of(BASE))).replace("@ALL@", str(CURRENT.mask | mask_of(BASE)))


def judge(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    return apply_policy(ledger(docs), policy).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_mask")
