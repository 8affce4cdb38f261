"""URL filter by association rules, in DataFrame functions and Spark ML only.

A short list of host and path rules decides first (the longest that fits). Its decisions label the
URLs it reaches; those without a listed rule carry no label and are not learnt from. Spark's FP-growth
mines which combinations of URL tokens go with ``block``. The least confidence is the one, from
min_confidence up, that judges a held-out part of the listed URLs best by rules of the others; the
rules used are then mined from all listed URLs. Rules are pruned by support and confidence, and a rule that contains a shorter one of no less confidence goes. The
rest are matched through an inverted index: each rule is filed under its rarest token, a URL looks up
its own tokens there, and what is found is checked against the whole token set. URLs are first
reduced to their distinct sets of mined tokens, so a common URL or host is matched once.

No frequent token is left out: only those with too few blocked URLs for any rule's support are, which
is exact. So at most (tokens a URL) / MIN_SUPPORT tokens pass through the driver.

Edge cases: a null URL or one without ``://`` has an empty host and path, no rule and no token, and
is allowed; with no blocked URL nothing is mined; with no allowed one all frequent tokens of the blocked
ones are rules; repeated rows and page ids come back
as often as they came; further columns are left out.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored

# (verdict, host, path prefix): fixed values of the query contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
MAX_RULES = 1000           # the list is written into the plan; longer ones are refused
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8       # the least that tuning may choose
CONFIDENCES = (0.85, 0.9, 0.95, 1.0)
HELD_OUT = 5               # one listed URL in so many, by hash of host and path, tunes the confidence
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with host, path and tail (query and fragment)."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (df.withColumn("_rest", rest)
            .withColumn("host", F.translate(F.regexp_extract("_rest", "^[^/?#]*", 0), _UPPER, _LOWER))
            .withColumn("path", F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1))
            .withColumn("tail", F.regexp_extract("_rest", "^[^?#]*([\\s\\S]*)", 1)).drop("_rest"))


def listed_rule(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; null without one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):   # the longest comes first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def url_tokens() -> Column:
    """Distinct tokens of a URL: host labels, the host's last two labels, path parts, file ending, parameter names."""
    labels = F.filter(F.split("host", "\\."), lambda x: x != "")
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    ending = F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1)
    names = F.transform(F.filter(F.split(F.regexp_replace("tail", "#[\\s\\S]*", ""), "[?&]"), lambda x: x != ""),
                        lambda x: F.substring_index(x, "=", 1))
    two = F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("domain:"), F.array_join(F.slice(labels, -2, 2), "."))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)), F.coalesce(two, none),
        F.transform(parts, lambda x: F.concat(F.lit("part:"), x)),
        F.when(ending != "", F.array(F.concat(F.lit("ending:"), ending))).otherwise(none),
        F.transform(names, lambda x: F.concat(F.lit("name:"), x)),
        F.when(F.col("tail").contains("#"), F.array(F.lit("anchor:"))).otherwise(none)))


def least_rows(n: int, min_support: float) -> int:
    """The fewest of ``n`` rows that reach the support."""
    return max(1, math.ceil(min_support * n - 1e-9))


def telling_tokens(labelled: DataFrame, items: int | None, min_support: float) -> list[str]:
    """The tokens that can be in a rule, the most common first: a rule's blocked rows hold each of its
    tokens, so those with fewer blocked rows than the support asks for can't. ``items``: only so many."""
    n, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not blocked:
        return []
    counts = (labelled.select("y", F.explode("tokens").alias("token")).groupBy("token")
              .agg(F.count(F.lit(1)).alias("k"), F.sum("y").alias("b")).filter(F.col("b") >= least_rows(n, min_support))
              .orderBy(F.desc("k"), "token"))
    return [r["token"] for r in (counts if items is None else counts.limit(items)).collect()]


def _texts(tokens: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in tokens]) if tokens else F.array().cast("array<string>")


def _held(sets: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs of a token set and an antecedent it holds, found by the antecedent's rarest token."""
    return (sets.withColumn("token", F.explode("set")).join(index, "token")
            .filter(F.size(F.array_except("antecedent", "set")) == 0))


def mine(labelled: DataFrame, tokens: list[str], min_support: float, min_confidence: float) -> DataFrame:
    """(rule_id, antecedent, confidence, support): pruned rules antecedent => block.

    FP-growth mines the blocked rows only; how many other rows hold an item set is counted in a join. It
    is spared what pruning would drop anyway: longer sets with a token that is always blocked, and sets
    with two tokens that always come together (one stands for all; the rules are written out for each)."""
    sets = stored(labelled.select(F.array_sort(F.array_intersect("tokens", _texts(tokens))).alias("set"), "y").groupBy("set")
                  .agg(F.count(F.lit(1)).alias("k"), F.sum("y").alias("b")), "url-sets")
    n, blocked = (int(x) for x in sets.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first())
    least = least_rows(n, min_support)
    single = (sets.select("k", "b", F.xxhash64("set").alias("h"), F.xxhash64(F.lit(1), "set").alias("g"), F.explode("set").alias("token"))
              .groupBy("token").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
              .filter(F.col("b") >= least))
    sure = single.filter("k = b").select(F.array("token").alias("antecedent"), F.lit(1.0).alias("confidence"),
                                         (F.col("b") / n).alias("support"))
    alike: dict[tuple, list[str]] = {}               # tokens of the same rows
    for r in single.filter("k > b").orderBy("token").collect():
        alike.setdefault((r["k"], r["b"], r["h"], r["g"]), []).append(r["token"])
    rules = sure
    if alike:
        chosen = _texts([same[0] for same in alike.values()])
        rows = labelled.filter("y = 1").select(F.array_intersect("tokens", chosen).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / max(1, blocked)).fit(rows)
        found = stored(model.freqItemsets.select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("b")), "url-item-sets")
        others = (_held(sets.filter("k > b").select("set", (F.col("k") - F.col("b")).alias("o")), rule_index(found, tokens))
                  .groupBy("antecedent").agg(F.sum("o").alias("o")))
        mixed = (found.join(others, "antecedent", "left")
                 .select("antecedent", (F.col("b") / (F.col("b") + F.coalesce("o", F.lit(0)))).alias("confidence"),
                         (F.col("b") / n).alias("support")).filter(F.col("confidence") >= min_confidence))
        mixed = stored(mixed, "url-rules")
        small = mixed.select(F.col("antecedent").alias("s_ante"), F.col("confidence").alias("s_conf"),
                             F.element_at("antecedent", 1).alias("token"))
        covered = (mixed.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(small, "token")
                   .filter((F.size("s_ante") < F.size("antecedent")) & (F.size(F.array_except("s_ante", "antecedent")) == 0)
                           & (F.col("s_conf") >= F.col("confidence"))).select("antecedent").distinct())
        same = F.create_map(*[c for v in alike.values() for c in (F.lit(v[0]), _texts(v))])
        written = F.aggregate("antecedent", F.array(F.array().cast("array<string>")), lambda done, t: F.flatten(
            F.transform(done, lambda d: F.transform(same[t], lambda m: F.concat(d, F.array(m))))))
        rules = sure.unionByName(mixed.join(covered, "antecedent", "left_anti").withColumn("antecedent", F.explode(written))
                                 .withColumn("antecedent", F.array_sort("antecedent")))
    return rules.withColumn("rule_id", F.xxhash64("antecedent")).select("rule_id", "antecedent", "confidence", "support")


def rule_index(rules: DataFrame, tokens: list[str]) -> DataFrame:
    """The inverted index: each antecedent under its least common token, the last in ``tokens``."""
    rarest = F.array_max(F.transform("antecedent", lambda t: F.struct(F.array_position(_texts(tokens), t).alias("p"), t.alias("t"))))["t"]
    return rules.select(rarest.alias("token"), "antecedent")


def tuned_confidence(labelled: DataFrame, min_support: float, min_confidence: float) -> float:
    """The least confidence whose rules, mined from the other rows, judge most ``held`` rows right; the lowest of equals."""
    learn = labelled.filter("not held")
    tokens = telling_tokens(learn, None, min_support)
    if not tokens:
        return min_confidence
    rules = stored(mine(learn, tokens, min_support, min_confidence), "url-tuning")
    index = rule_index(rules, tokens).join(rules.select("antecedent", "confidence"), "antecedent")
    sets = (labelled.filter("held").select(F.array_sort(F.array_intersect("tokens", _texts(tokens))).alias("set"), "y")
            .groupBy("set").agg(F.sum("y").alias("b"), F.sum(1 - F.col("y")).alias("o")))
    best = _held(sets.select("set"), index).groupBy("set").agg(F.max("confidence").alias("best"))
    levels = [min_confidence, *(c for c in CONFIDENCES if c > min_confidence)]
    right = sets.join(best, "set", "left").agg(*[
        F.coalesce(F.sum(F.when(F.coalesce("best", F.lit(-1.0)) >= c, F.col("b")).otherwise(F.col("o"))), F.lit(0)) for c in levels]).first()
    return max(zip(levels, right), key=lambda x: (x[1], -x[0]))[0]


def judge(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rules (how many mined rules match a URL without a listed one)."""
    name, verdict = listed_rule(rules)
    df = split_url(pages.select("page_id", F.col("url").cast("string").alias("url")))
    df = df.withColumn("rule", name).withColumn("listed", verdict).withColumn("tokens", url_tokens())
    held = F.pmod(F.xxhash64("host", "path"), F.lit(HELD_OUT)) == 0
    labelled = df.filter("listed is not null").select((F.col("listed") == "block").cast("int").alias("y"), "tokens", held.alias("held"))
    tokens = telling_tokens(labelled, None, min_support)
    if not tokens:
        return df.select("page_id", "host", "path", "rule", F.coalesce("listed", F.lit("allow")).alias("verdict"),
                         F.lit(0).cast("long").alias("mined_rules"))
    confidence = tuned_confidence(labelled, min_support, min_confidence)
    index = rule_index(stored(mine(labelled, tokens, min_support, confidence), "url-pruned"), tokens)
    df = df.withColumn("set", F.array_sort(F.array_intersect("tokens", _texts(tokens))))
    sets = df.filter("listed is null").select("set").distinct()
    fired = _held(sets, index).groupBy("set").agg(F.count(F.lit(1)).alias("mined"))
    out = df.select("page_id", "host", "path", "rule", "listed", "set").join(fired, "set", "left")
    mined = F.when(F.col("listed").isNull(), F.coalesce("mined", F.lit(0))).otherwise(F.lit(0))
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("listed", F.when(mined > 0, "block").otherwise("allow")).alias("verdict"),
                      mined.cast("long").alias("mined_rules"))
