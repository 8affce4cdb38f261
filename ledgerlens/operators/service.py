"""Scoring-service counters and exact order statistics (AGG-10, AGG-11).

The reference keeps these as in-process counters over a bounded ring; here they are aggregate
queries over the ``scored`` table, so they cover every row and any time window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.operators.lookup import null_safe_join
from ledgerlens.session import cut_lineage

DEFAULT_BUCKETS = 4096


def service_counters(scored: DataFrame, by: list[str | Column] | None = None, flag: str = "is_fraud",
                     score: str = "fused_score", latency: str | None = "latency_ms") -> DataFrame:
    """AGG-10: scored, flagged, errors (no score), mean latency (2 dp) and flagged rate
    flagged / max(scored, 1) (6 dp), overall or per group."""
    aggs = [F.count(F.lit(1)).alias("total_scored"),
            F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias("total_flagged"),
            F.count_if(F.col(score).isNull()).alias("errors")]
    if latency and latency in scored.columns:
        aggs.append(C.fixed(F.avg(latency), 2).alias("avg_latency_ms"))
    g = scored.groupBy(*by) if by else scored
    a = g.agg(*aggs)
    return a.withColumn("flagged_rate", C.fixed(F.col("total_flagged").cast("double")
                                                 / F.greatest(F.col("total_scored"), F.lit(1)).cast("double"), 6))


def exact_quantile(df: DataFrame, value: str, q: float = 0.99, by: list[str] | None = None,
                   buckets: int = DEFAULT_BUCKETS, out: str = "p99", levels: int = 3) -> DataFrame:
    """AGG-11: the element at 0-based index min(int(q*n), n-1) of the sorted values, per group
    (empty input -> no row; the caller may default it to 0).

    Distributed selection, no global sort and no single-task group: values are counted per
    distinct value (duplicates collapse map-side) and written once; then, ``levels`` times,
    the group's current range is cut into equal-width buckets, bucket counts are cumulated on
    a table of groups x buckets rows, and the range shrinks to the actual min..max of the one
    bucket that holds the target rank (the rank shifts by the counts below it). Heavy-tailed
    values therefore end in a narrow range; only those few distinct values are ranked."""
    by = list(by or [])
    keys = by if by else ["_g"]
    v = F.col(value).cast("double")
    base = df.where(v.isNotNull() & ~F.isnan(v))
    if not by:
        base = base.withColumn("_g", F.lit(0))
    vc = cut_lineage(base.groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    rng = vc.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"))
    rng = rng.select(*keys, "_lo", "_hi", F.least(F.floor(F.lit(float(q)) * F.col("_n").cast("double")) + 1,
                                                  F.col("_n")).alias("_k"))
    for _ in range(levels):
        cand = null_safe_join(vc, rng, keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        width = F.col("_hi") - F.col("_lo")
        cand = cand.withColumn("_b", F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width
                                                                        * F.lit(float(buckets))), F.lit(buckets - 1)))
                               .otherwise(F.lit(0)))
        bc = cand.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"), F.min("_v").alias("_blo"),
                                           F.max("_v").alias("_bhi"), F.first("_k").alias("_k"))
        wo = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        bc = bc.withColumn("_off", F.coalesce(F.sum("_bc").over(wo), F.lit(0)))
        rng = bc.where((F.col("_off") < F.col("_k")) & (F.col("_k") <= F.col("_off") + F.col("_bc"))).select(
            *keys, F.col("_blo").alias("_lo"), F.col("_bhi").alias("_hi"), (F.col("_k") - F.col("_off")).alias("_k"))
    last = null_safe_join(vc, rng, keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    wr = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = last.withColumn("_cum", F.sum("_c").over(wr))
    hit = ranked.where((F.col("_cum") >= F.col("_k")) & (F.col("_cum") - F.col("_c") < F.col("_k")))
    return hit.select(*by, F.col("_v").alias(out))
