"""Population stability drift (DR-1..5, FLT-6/7) on mergeable histograms.

``fit_histogram`` fixes ten equal-width bins a feature on the reference (edges lo + i*step, last edge
= hi; a constant reference widens by 0.5 each way; an empty one uses [0, 1]) and counts it: a table of
one row a feature and bin, written once and kept. ``count_cells`` counts any other rows in the same
bins. Counts of disjoint rows (days, micro-batches, partitions) add up, so a window's histogram is a
sum of small tables and the reference is never read again.

Counting reads wide rows once: a task counts the cells of its rows batch by batch and hands on one row
a cell; no (feature, value) rows are made or joined to edges. A
value's bin is the number of interior edges it reaches, by exact comparisons, so the last bin is
closed and values outside [lo, hi] are in no bin but still in the denominator (cell OUTSIDE).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.session import cut_lineage

# Fixed values (must equal the reference's): bins, smoothing, PSI and dataset thresholds.
N_BINS = 10
EPS = 1e-10
PSI_THRESHOLD = 0.2
DATASET_SHARE = 0.1
RETRAIN_SHARE = 0.15


def common_columns(ref: DataFrame, cur: DataFrame, cols: list[str]) -> list[str]:
    """FLT-7: monitored columns present in both frames, in the requested order."""
    return [c for c in cols if c in ref.columns and c in cur.columns]


def _clean(c: str) -> Column:
    """FLT-6: NULL, NaN and infinite values are dropped per feature."""
    v = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def histogram_edges(ref: DataFrame, features: list[str], n_bins: int = N_BINS) -> dict[str, list[float]]:
    """DR-1: the n_bins + 1 edges of every monitored feature, from one aggregate row."""
    aggs = [f(_clean(c)).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("lo", F.min), ("hi", F.max))]
    row = ref.agg(*aggs).first() if aggs else None
    out = {}
    for i, c in enumerate(features):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is None:
            lo, hi = 0.0, 1.0
        elif lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        step = (hi - lo) / float(n_bins)
        out[c] = [i * step + lo for i in range(n_bins)] + [hi]
    return out


CELLS = "feature string, bin int, n long"
FITTED = "feature string, lo double, hi double, bin int, n long"


def count_cells(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """(feature, bin, n) of ``df``: every bin of every feature of ``edges``, empty ones included, and the
    values outside all of them as bin = number of bins. One scan; the result adds up over disjoint rows."""
    spark = df.sparkSession
    features = list(edges)
    if not features:
        return spark.createDataFrame([], CELLS)
    width = len(edges[features[0]])                # bins and one cell for what is outside
    cells = len(features) * width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(cells, np.int64)
        for b in batches:
            for i, c in enumerate(features):
                v, e = b.column(i).to_numpy(zero_copy_only=False), edges[c]
                v = v[~np.isnan(v)]                # null
                bins = np.searchsorted(np.array(e[1:-1]), v, side="right")
                bins[~((v >= e[0]) & (v <= e[-1]))] = width - 1
                n[i * width:(i + 1) * width] += np.bincount(bins, minlength=width)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["_cell", "n"])

    values = df.select(*[_clean(c).alias(f"_v{i}") for i, c in enumerate(features)])
    counted = values.mapInArrow(count, "_cell int, n long").groupBy("_cell").agg(F.sum("n").alias("n"))
    # one row a cell, a fixed number: features x (bins + 1)
    scaffold = spark.createDataFrame([(c, b, i * width + b) for i, c in enumerate(features) for b in range(width)],
                                     "feature string, bin int, _cell int")
    return scaffold.join(counted, "_cell", "left").select("feature", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def merge_cells(cells: DataFrame, *by: str) -> DataFrame:
    """Sum of histograms over disjoint rows, per ``by``."""
    return cells.groupBy(*by, "feature", "bin").agg(F.sum("n").alias("n"))


def fit_histogram(ref: DataFrame, cols: list[str], n_bins: int = N_BINS) -> DataFrame:
    """DR-1: the reference's histogram as a written table (feature, lo, hi, bin, n)."""
    edges = histogram_edges(ref, cols, n_bins)
    if not edges:
        return ref.sparkSession.createDataFrame([], FITTED)
    ends = ref.sparkSession.createDataFrame([(c, e[0], e[-1]) for c, e in edges.items()], "feature string, lo double, hi double")
    return cut_lineage(count_cells(ref, edges).join(ends, "feature").select("feature", "lo", "hi", "bin", "n"))


def edges_of(fitted: DataFrame) -> dict[str, list[float]]:
    """The edges of a fitted histogram, by feature: a row each, so a bounded collect."""
    rows = fitted.groupBy("feature").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.max("bin").alias("k")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r["feature"]):
        step = (r["hi"] - r["lo"]) / float(r["k"])
        out[r["feature"]] = [i * step + r["lo"] for i in range(r["k"])] + [r["hi"]]
    return out


def psi_of(fitted: DataFrame, cells: DataFrame, *by: str) -> DataFrame:
    """DR-2 from two histograms: (by, feature, psi) with shares (count + eps) / (total + eps) and
    psi = sum((c - r) * ln(c / r)) over the reference bins."""
    total = Window.partitionBy("feature")
    width = F.max("bin").over(total)
    ref = fitted.select("feature", "bin", F.col("n").alias("r_n"), F.sum("n").over(total).alias("n_ref"), width.alias("_k"))
    cur = cells.select(*by, "feature", "bin", F.col("n").alias("c_n"),
                       F.sum("n").over(Window.partitionBy(*by, "feature")).alias("n_cur"))
    eps = F.lit(EPS)
    r = (F.col("r_n").cast("double") + eps) / (F.col("n_ref").cast("double") + eps)
    c = (F.col("c_n").cast("double") + eps) / (F.col("n_cur").cast("double") + eps)
    return (cur.join(ref, ["feature", "bin"]).where(F.col("bin") < F.col("_k"))
            .groupBy(*by, "feature").agg(F.sum((c - r) * F.log(c / r)).alias("psi")))


def psi(ref: DataFrame, cur: DataFrame, cols: list[str], n_bins: int = N_BINS) -> DataFrame:
    """DR-2: (feature, psi) of two frames: the reference is scanned for its ends and its counts, the
    current frame once."""
    fitted = fit_histogram(ref, common_columns(ref, cur, cols), n_bins)
    return psi_of(fitted, count_cells(cur, edges_of(fitted)))


def feature_drift(psi_df: DataFrame, threshold: float = PSI_THRESHOLD) -> DataFrame:
    """DR-3: (feature, psi rounded to 4 dp, drifted = psi > threshold on the exact value)."""
    return psi_df.select("feature", C.fixed("psi", 4).alias("psi"), (F.col("psi") > F.lit(threshold)).alias("drifted"))


def dataset_drift(fd: DataFrame, share: float = DATASET_SHARE) -> DataFrame:
    """DR-4: monitored / drifted feature counts, drift_score = drifted / max(n, 1) (4 dp),
    drift_detected = score > share."""
    a = fd.agg(F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("drifted")).alias("n_drifted"))
    score = F.col("n_drifted").cast("double") / F.greatest(F.col("n_features"), F.lit(1)).cast("double")
    return a.select("n_features", "n_drifted", C.fixed(score, 4).alias("drift_score"),
                    (score > F.lit(share)).alias("drift_detected"))


def should_retrain(dd: DataFrame, threshold: float = RETRAIN_SHARE) -> DataFrame:
    """DR-5: retrain when drift is detected and the (rounded) score reaches the threshold."""
    return dd.withColumn("retrain", F.col("drift_detected") & (F.col("drift_score") >= F.lit(threshold)))


def drift_report(ref: DataFrame, cur: DataFrame, cols: list[str], threshold: float = PSI_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``(feature_drift, dataset_drift)`` for two frames."""
    fd = feature_drift(psi(ref, cur, cols), threshold)
    return fd, dataset_drift(fd)
