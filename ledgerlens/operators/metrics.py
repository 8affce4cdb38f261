"""Imbalance-aware evaluation metrics as aggregate plans (EVAL-0..8).

All curve metrics derive from one score curve: per distinct score, true / false positives
cumulated from the highest score down. The cumulation never uses a single-partition window:
distinct scores are cut into ``buckets`` order-preserving, count-balanced ranges, the running
sum inside a bucket is a window partitioned by bucket, and the bucket offsets come from a table
of at most ``buckets`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C

DEFAULT_BUCKETS = 4096


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Attach the single row of ``b`` to every row of ``a``: ``b`` is one row (a fixed bound), so it
    is broadcast and ``a`` is never shuffled on the constant key."""
    return a.withColumn("_k", F.lit(1)).join(F.broadcast(b.withColumn("_k", F.lit(1))), "_k").drop("_k")


def score_buckets(g: DataFrame, buckets: int) -> DataFrame:
    """Order-preserving bucket ``_b`` per distinct score, balanced by count: boundaries are
    approximate quantiles of the distinct scores (one bounded list of ``buckets - 1`` values),
    applied with a JVM binary search. Scores pile up near 0 for rare-event models, so equal-width
    buckets would put most distinct scores into one window partition."""
    from pyspark.ml.feature import Bucketizer
    probs = [i / buckets for i in range(1, buckets)]
    cuts = g.approxQuantile("score", probs, 1.0 / (4 * buckets)) if buckets > 1 else []
    splits = [float("-inf")] + sorted({float(c) for c in cuts}) + [float("inf")]
    if len(splits) < 3:
        return g.withColumn("_b", F.lit(0))
    bz = Bucketizer(splits=splits, inputCol="score", outputCol="_bd")
    return bz.transform(g).withColumn("_b", F.col("_bd").cast("int")).drop("_bd")


def score_curve(df: DataFrame, label: str = "label", score: str = "score", buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """EVAL-0: (score, tp, fp, ctp, cfp, P, N) per distinct score, cumulated from high to low.
    Rows with a missing or NaN score are left out."""
    s = F.col(score).cast("double")
    g = (df.where(s.isNotNull() & ~F.isnan(s))
         .groupBy(s.alias("score"))
         .agg(F.count_if(F.col(label) == 1).alias("tp"), F.count_if(F.col(label) != 1).alias("fp")))
    g = score_buckets(g, buckets)
    wl = Window.partitionBy("_b").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = g.withColumn("_ltp", F.sum("tp").over(wl)).withColumn("_lfp", F.sum("fp").over(wl))
    tot = g.groupBy("_b").agg(F.sum("tp").alias("_btp"), F.sum("fp").alias("_bfp"))
    wo = Window.partitionBy(F.lit(0)).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_b", F.coalesce(F.sum("_btp").over(wo), F.lit(0)).alias("_otp"),
                     F.coalesce(F.sum("_bfp").over(wo), F.lit(0)).alias("_ofp"))
    totals = g.agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("P"), F.coalesce(F.sum("fp"), F.lit(0)).alias("N"))
    curve = local.join(F.broadcast(off), "_b").select(
        "score", "tp", "fp", (F.col("_otp") + F.col("_ltp")).alias("ctp"), (F.col("_ofp") + F.col("_lfp")).alias("cfp"))
    return _one_row_join(curve, totals)


def _prec(tp, fp):
    return F.when((tp + fp) > 0, tp.cast("double") / (tp + fp).cast("double"))


def curve_metrics(curve: DataFrame, fpr_targets: tuple[float, ...] = (0.05,)) -> DataFrame:
    """EVAL-1/2/3/5 from a score curve, one row."""
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    ctp, cfp, tp, fp = F.col("ctp"), F.col("cfp"), F.col("tp"), F.col("fp")
    prec = _prec(ctp, cfp)
    prev_prec = F.coalesce(_prec(ctp - tp, cfp - fp), F.lit(1.0))
    d_rec = tp.cast("double") / P
    aggs = [
        F.sum(d_rec * prec).alias("_ap"),
        F.sum(d_rec * (prec + prev_prec) / F.lit(2.0)).alias("_apt"),
        F.sum(fp.cast("double") * (ctp + ctp - tp).cast("double") / F.lit(2.0)).alias("_roc"),
        F.first("P").alias("_P"), F.first("N").alias("_N"),
    ]
    for t in fpr_targets:
        ok = (cfp.cast("double") / N) <= F.lit(float(t))
        aggs.append(F.max(F.when(ok, ctp.cast("double") / P)).alias(f"_r{int(t * 100)}"))
    a = curve.agg(*aggs)
    has_both = (F.col("_P") > 0) & (F.col("_N") > 0)
    out = [C.fixed(F.when(F.col("_P") > 0, F.col("_ap")).otherwise(0.0), 6).alias("pr_auc"),
           C.fixed(F.when(F.col("_P") > 0, F.col("_apt")).otherwise(0.0), 6).alias("pr_auc_trapezoid"),
           C.fixed(F.when(has_both, F.col("_roc") / (F.col("_P") * F.col("_N")).cast("double")).otherwise(0.0), 6)
           .alias("roc_auc")]
    for t in fpr_targets:
        out.append(C.fixed(F.when(has_both, F.coalesce(F.col(f"_r{int(t * 100)}"), F.lit(0.0))).otherwise(0.0), 6)
                   .alias(f"recall_at_fpr_{int(t * 100)}pct"))
    return a.select(*out)


def pr_auc(df, label="label", score="score"):
    """EVAL-1: average precision (step sum of ΔR·P)."""
    return curve_metrics(score_curve(df, label, score)).select("pr_auc")


def pr_auc_trapezoid(df, label="label", score="score"):
    """EVAL-2: trapezoid area under the PR curve starting at (0, 1)."""
    return curve_metrics(score_curve(df, label, score)).select("pr_auc_trapezoid")


def roc_auc(df, label="label", score="score"):
    """EVAL-3: trapezoid ROC area; 0 when only one class is present."""
    return curve_metrics(score_curve(df, label, score)).select("roc_auc")


def recall_at_fpr(df, label="label", score="score", target: float = 0.05):
    """EVAL-5: best recall with FPR <= target (exact curve, no point dropping)."""
    return curve_metrics(score_curve(df, label, score), (target,)).select(f"recall_at_fpr_{int(target * 100)}pct")


def precision_recall_f1(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5,
                        pred: str | None = None) -> DataFrame:
    """EVAL-4: precision, recall, F1 of ``score >= threshold`` (or a given 0/1 ``pred``);
    zero divisions give 0."""
    p = (F.col(pred) == 1) if pred else (F.col(score) >= F.lit(float(threshold)))
    y = F.col(label) == 1
    a = df.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("tp").cast("double"),
                                 (F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0))
    return a.select(C.fixed(prec, 6).alias("precision_at_05"), C.fixed(rec, 6).alias("recall_at_05"),
                    C.fixed(f1, 6).alias("f1_at_05"))


def prevalence(df: DataFrame, label: str = "label") -> DataFrame:
    """EVAL-6: positive rate (6 dp), rows and positives."""
    return df.agg(C.fixed(F.avg(F.col(label).cast("double")), 6).alias("fraud_rate_test"),
                  F.count(F.lit(1)).alias("n_test"), F.count_if(F.col(label) == 1).alias("n_fraud_test"))


def evaluate(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5,
             fixed_fpr: float = 0.05) -> DataFrame:
    """EVAL-7 (``evaluate_classifier``): every metric in one row."""
    cm = curve_metrics(score_curve(df, label, score), (fixed_fpr,))
    return _one_row_join(_one_row_join(cm, precision_recall_f1(df, label, score, threshold)), prevalence(df, label))


def compare_models(df: DataFrame, scores: dict[str, str], label: str = "label", threshold: float = 0.5) -> DataFrame:
    """EVAL-8: metric | one column per model | difference of the second minus the first.
    Each model is evaluated on the rows where its score is present."""
    names = list(scores)
    longs = []
    for name, col in scores.items():
        m = evaluate(df.where(F.col(col).isNotNull()), label, col, threshold)
        metric_cols = [c for c in m.columns if c not in ("n_test", "n_fraud_test")]
        stack = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in metric_cols)
        longs.append(m.selectExpr(f"stack({len(metric_cols)}, {stack}) AS (metric, value)")
                     .withColumn("model", F.lit(name)))
    u = longs[0]
    for x in longs[1:]:
        u = u.unionByName(x)
    p = u.groupBy("metric").pivot("model", names).agg(F.first("value"))
    if len(names) >= 2:
        p = p.withColumn("delta", C.fixed(F.col(names[1]) - F.col(names[0]), 6))
    return p
