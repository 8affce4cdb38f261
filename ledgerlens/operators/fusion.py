"""Score fusion, alert flags and the analyst feed (ML-5/6, FLT-1..3, WIN-5..7, PRJ-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C

# Fusion defaults and the alert status band (must equal the reference's).
DEFAULT_TABULAR_WEIGHT = 0.6
DEFAULT_THRESHOLD = 0.5
FRAUD_BAND = 0.7
ALERT_CAP = 500


def check_weight(w: float) -> float:
    if not 0.0 <= w <= 1.0:
        raise ValueError(f"tabular_weight must be in [0, 1], got {w}")
    return float(w)


def fuse(df: DataFrame, tabular: str = "tabular_score", graph: str = "gnn_score",
         tabular_weight: float = DEFAULT_TABULAR_WEIGHT, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """ML-5: fused = w*tab + (1-w)*graph, or tab alone (weights 1/0) when the graph score is
    missing; ``is_fraud`` = fused >= threshold on the unrounded value; confidence = distance
    from the threshold scaled by max(t, 1-t). Scores are rounded to 6 dp, confidence to 4."""
    w = check_weight(tabular_weight)
    gw = 1.0 - w
    t, g = F.col(tabular).cast("double"), F.col(graph).cast("double")
    fused = F.when(g.isNull(), t).otherwise(F.lit(w) * t + F.lit(gw) * g)
    conf = F.abs(fused - F.lit(float(threshold))) / F.lit(max(threshold, 1.0 - threshold))
    return df.select(
        "*",
        C.fixed(fused, 6).alias("fused_score"),
        (fused >= F.lit(float(threshold))).alias("is_fraud"),
        C.fixed(conf, 4).alias("confidence"),
        F.when(g.isNull(), F.lit(1.0)).otherwise(F.lit(w)).alias("weight_tabular"),
        F.when(g.isNull(), F.lit(0.0)).otherwise(F.lit(gw)).alias("weight_graph"),
        F.lit(float(threshold)).alias("threshold"))


def fuse_equal(df: DataFrame, tabular: str = "tabular_score", graph: str = "gnn_score") -> DataFrame:
    """ML-6: equal weights."""
    return fuse(df, tabular, graph, 0.5, DEFAULT_THRESHOLD)


def flag(df: DataFrame, score: str = "fused_score", threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """FLT-1: rows at or above the threshold (inclusive). Rows that ``fuse`` scored carry its decision on
    the unrounded score; it is taken over where the threshold is the one they were fused with."""
    above = F.col(score) >= F.lit(float(threshold))
    if score == "fused_score" and {"is_fraud", "threshold"} <= set(df.columns):
        above = F.when(F.col("threshold") == F.lit(float(threshold)), F.col("is_fraud")).otherwise(above)
    return df.where(above)


def min_risk(df: DataFrame, x: float, score: str = "fused_score") -> DataFrame:
    """FLT-2: keep rows whose score (missing = 0) is at least ``x``."""
    return df.where(F.coalesce(F.col(score), F.lit(0.0)) >= F.lit(float(x)))


def status_band(score: str = "fused_score"):
    """FLT-3: FRAUD at or above 0.7, else SUSPICIOUS."""
    return F.when(F.coalesce(F.col(score), F.lit(0.0)) >= F.lit(FRAUD_BAND), "FRAUD").otherwise("SUSPICIOUS")


def tx_display(df: DataFrame, score: str = "fused_score") -> DataFrame:
    """PRJ-13: analyst table — ids cut to 12 characters, money and score formatted, status."""
    return df.select(
        C.short_id("tx_id").alias("transaction"), C.short_id("sender_account").alias("sender"),
        C.short_id("receiver_account").alias("receiver"), C.money("amount_paid").alias("amount"),
        F.format_string("%.4f", F.col(score)).alias("fused_risk"), status_band(score).alias("status"))


def latest(df: DataFrame, n: int, ts: str = "ts", key: str = "tx_id") -> DataFrame:
    """WIN-5: the newest ``n`` rows (ts desc, key desc) — a TakeOrdered, not a global sort."""
    return df.orderBy(F.col(ts).desc_nulls_last(), F.col(key).desc()).limit(n)


def recent_alerts(alerts: DataFrame, limit: int = 50, cap: int = ALERT_CAP, ts: str = "ts",
                  key: str = "tx_id") -> DataFrame:
    """WIN-6: newest alerts first, at most min(limit, cap); limit 0 returns nothing."""
    n = max(0, min(int(limit), int(cap)))
    return latest(alerts, n, ts, key)


def top_k_factors(contrib: str = "contributions", k: int = 5):
    """WIN-7 + ML-8: per row, the k (feature, contribution) entries of largest |contribution|
    (ties by feature name), with direction 'increases' (> 0) or 'decreases'. Higher-order
    array functions — no shuffle."""
    def cmp(a, b):
        return (F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1)
                .when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1)
                .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0))
    top = F.slice(F.array_sort(F.col(contrib), cmp), 1, k)
    return F.transform(top, lambda e: F.struct(
        e["feature"].alias("feature"), C.fixed(e["contribution"], 6).alias("contribution"),
        F.when(e["contribution"] > 0, "increases").otherwise("decreases").alias("direction")))


def time_ordered(df: DataFrame, ts: str = "ts", key: str = "tx_id") -> DataFrame:
    """WIN-8: global order by event time (ties by key) — a range-partitioned sort, each task
    sorting one contiguous time slice."""
    return df.orderBy(F.col(ts).asc_nulls_last(), F.col(key))
