"""Structured Streaming jobs (ST-1..8).

The same column functions as the batch path score each micro-batch; account history joins
as a stream-static join with the profile table; stateful parts use event-time watermarks
(windowed counters, sliding velocity, dedup) or ``applyInPandasWithState`` (running account
statistics). Sinks are checkpointed; ``foreachBatch`` writers overwrite one folder per batch
id, so a replayed batch replaces its own output instead of duplicating it.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ledgerlens.functions import columns as C
from ledgerlens.operators import drift as DR
from ledgerlens.operators import features as FE
from ledgerlens.operators import fusion as FU
from ledgerlens.session import configure, scratch_path
from ledgerlens.sources import sinks as SK
from ledgerlens.sources import transactions as SRC


# --- sources (ST-1) -------------------------------------------------------------------------------

def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """ST-1: file stream with an explicit schema; ``max_files_per_trigger`` bounds each batch
    (the back-pressure of the reference's bounded queue)."""
    configure(spark)
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def read_kafka_stream(spark: SparkSession, servers: str, topic: str, schema, max_offsets: int | None = None) -> DataFrame:
    """ST-1 (message bus): JSON transaction messages from a topic (needs the Kafka connector
    on the classpath; only the plan is built here)."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if max_offsets:
        r = r.option("maxOffsetsPerTrigger", str(max_offsets))
    raw = r.load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")


# --- scoring (ST-2, ST-3) -------------------------------------------------------------------------

def online_features(stream: DataFrame, dictionaries: DataFrame | None = None, sender_profile: DataFrame | None = None,
                    receiver_profile: DataFrame | None = None) -> DataFrame:
    """ST-2 features: the batch projections (PRJ-1..12) with the training run's dictionaries (without
    them every category is unseen, -1) and account profiles (0 when unknown), both by stream-static
    left joins."""
    f = FE.cross_flags(FE.amount_features(FE.time_features(stream)))
    if dictionaries is None:
        for c in ("payment_currency_enc", "receiving_currency_enc", "payment_format_enc"):
            f = f.withColumn(c, F.lit(-1))
    else:
        f = FE.encode_categories(f, dictionaries)
    if sender_profile is not None and receiver_profile is not None:
        return FE.attach_profiles(f, sender_profile, receiver_profile)
    for c in FE.SENDER_COLS + FE.RECEIVER_COLS:
        f = f.withColumn(c, F.lit(0.0) if ("amount" in c) else F.lit(0).cast("long"))
    return f


def score_stream(features: DataFrame, tabular_model=None, tabular_score: str | None = None,
                 tabular_weight: float = FU.DEFAULT_TABULAR_WEIGHT, threshold: float = FU.DEFAULT_THRESHOLD) -> DataFrame:
    """ST-2: tabular probability from a fitted pipeline (or an existing score column), no
    graph score online (fusion falls back to weights 1/0), then ML-5."""
    if tabular_model is not None:
        from ledgerlens.operators.models import score
        s = score(tabular_model, features, "tabular_score")
    else:
        s = features.withColumn("tabular_score", F.col(tabular_score).cast("double"))
    s = s.withColumn("gnn_score", F.lit(None).cast("double"))
    return FU.fuse(s, tabular_weight=tabular_weight, threshold=threshold).withColumn("scored_at", F.current_timestamp())


def write_alert_stream(scored: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """ST-3 + SNK-2: flagged rows as JSON alert records, one folder per batch id."""
    tx_cols = [c for c in SRC.TX_COLUMNS if c in scored.columns]

    def sink(batch: DataFrame, batch_id: int):
        rec = SK.alert_records(batch.where(F.col("is_fraud")), tx_cols)
        rec.write.mode("overwrite").json(os.path.join(path, f"batch={batch_id}"))

    w = scored.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


# --- stateful operators (ST-4..7) ------------------------------------------------------------------

def stream_counters(scored: DataFrame, window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """ST-4: per event-time window, scored / flagged / errors / flagged rate."""
    w = scored.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"))
    a = w.agg(F.count(F.lit(1)).alias("total_scored"),
              F.count_if(F.coalesce(F.col("is_fraud"), F.lit(False))).alias("total_flagged"),
              F.count_if(F.col("fused_score").isNull()).alias("errors"))
    return a.select(F.col("w.start").alias("window_start"), "total_scored", "total_flagged", "errors",
                    C.fixed(F.col("total_flagged").cast("double")
                            / F.greatest(F.col("total_scored"), F.lit(1)).cast("double"), 6).alias("flagged_rate"))


def account_velocity(stream: DataFrame, window: str = "1 hour", slide: str = "10 minutes",
                     watermark: str = "1 hour", key: str = "sender_account") -> DataFrame:
    """ST-5: sliding-window transfer count, amount and approximate distinct counterparties
    (exact distinct is not supported on streams)."""
    g = stream.withWatermark("ts", watermark).groupBy(F.col(key).alias("account_id"),
                                                      F.window("ts", window, slide).alias("w"))
    a = g.agg(F.count(F.lit(1)).alias("n_tx"), F.sum("amount_paid").alias("amount"),
              F.approx_count_distinct("receiver_account").alias("n_counterparties"))
    return a.select("account_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "n_tx", C.fixed("amount", 4).alias("amount"), "n_counterparties")


def account_velocity_exact(stream: DataFrame, window: str = "1 hour", slide: str = "10 minutes",
                           watermark: str = "1 hour", key: str = "sender_account") -> DataFrame:
    """ST-5 with exact distinct counterparties, for any number of them: two chained aggregations, first
    by (account, window, counterparty), then by (account, window). A hot account's state is spread by
    counterparty, is partially aggregated before each shuffle and leaves with the watermark.

    Append mode: a window comes out once, when the watermark has passed its end. A null counterparty
    counts as a transfer but not as a counterparty; a missing amount adds nothing."""
    w = F.window("ts", window, slide).alias("w")
    amount = F.col("amount_paid").cast(FE.MONEY_DEC)
    by_pair = (stream.withWatermark("ts", watermark).groupBy(F.col(key).alias("account_id"), w, "receiver_account")
               .agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("s")))
    a = by_pair.groupBy("account_id", "w").agg(F.sum("n").alias("n_tx"), F.sum("s").alias("s"),
                                               F.count("receiver_account").alias("n_counterparties"))
    return a.select("account_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_tx",
                    C.fixed(F.coalesce(F.col("s").cast("double"), F.lit(0.0)), 4).alias("amount"), "n_counterparties")


RUNNING_SCHEMA = ("tx_id string, account_id string, prior_count long, prior_sum double, prior_mean double, "
                  "prior_std double")
# statistics of the rows before the latest timestamp, that timestamp, statistics of the rows at it
RUNNING_STATE = ("n long, total double, mean double, m2 double, last_t long, "
                 "last_n long, last_total double, last_mean double, last_m2 double")
NONE_YET = (0, 0.0, 0.0, 0.0)


def _merge(a, b):
    """(n, sum, mean, M2) of two disjoint sets; scalars or arrays."""
    n = a[0] + b[0]
    d = b[2] - a[2]
    some = np.maximum(n, 1)
    return n, a[1] + b[1], np.where(n > 0, (a[0] * a[2] + b[0] * b[2]) / some, 0.0), a[3] + b[3] + d * d * a[0] * b[0] / some


def _of(x):
    mean = float(x.mean()) if len(x) else 0.0
    return len(x), float(x.sum()), mean, float(((x - mean) ** 2).sum())


def _columns_of(pdfs):
    """Ids, times and amounts of an account's rows, in order of time and id. The rows come in bounded
    frames; only these three arrays are kept of them."""
    parts = [(p["tx_id"].astype(str).to_numpy(object), p["_t"].to_numpy("int64"), p["_x"].to_numpy(float)) for p in pdfs]
    ids, t, x = (np.concatenate([q[i] for q in parts]) for i in range(3))
    order = np.lexsort((ids.astype(str), t))
    return ids[order], t[order], x[order]


def _advance(s, t, x):
    """Rows (times ascending, amounts) of one account after state ``s``: (count, sum, mean, std) known
    before each row, and the next state."""
    base, last_t, at_last = s[:4], s[4], s[5:]
    counted = ~np.isnan(x)
    piv = float(x[counted][0]) if counted.any() else 0.0
    d = np.where(counted, x - piv, 0.0)
    run = lambda v: np.concatenate([[0.0], np.cumsum(v)])
    first = np.searchsorted(t, t, "left")          # rows of one timestamp see only the rows before it
    k = run(counted)[first].astype("int64")
    cd, cd2 = run(d)[first], run(d * d)[first]
    some = np.maximum(k, 1)
    inside = (k, run(np.where(counted, x, 0.0))[first], np.where(k > 0, piv + cd / some, 0.0), cd2 - cd * cd / some)
    later = t > last_t
    known = _merge(base, at_last)
    before = tuple(np.where(later, w, o) for w, o in zip(known, base))
    n, total, mean, m2 = _merge(before, inside)
    std = np.where(n > 1, np.sqrt(np.maximum(m2, 0.0) / np.maximum(n - 1, 1)), 0.0)
    top = int(t[-1])
    if top > last_t:
        base, at_last = known, NONE_YET
    newest = max(top, last_t)
    base = _merge(base, _of(x[counted & (t < newest)]))
    at_last = _merge(at_last, _of(x[counted & (t == newest)]))
    num = lambda v: (int(v[0]), float(v[1]), float(v[2]), float(v[3]))
    return (n.astype("int64"), total, mean, std), (*num(base), int(newest), *num(at_last))


NO_STATE = (*NONE_YET, np.iinfo(np.int64).min, *NONE_YET)


def _running(key, pdfs, state, expire_us=None):
    if state.hasTimedOut:
        state.remove()
        return
    s = state.get if state.exists else NO_STATE
    ids, t, x = _columns_of(pdfs)
    if not len(t):
        return
    starts = [0] if expire_us is None else [0, *(np.flatnonzero(np.diff(t) > expire_us) + 1)]
    for i, j in zip(starts, [*starts[1:], len(t)]):
        if expire_us is not None and s[4] != NO_STATE[4] and int(t[i]) - s[4] > expire_us:
            s = NO_STATE
        (n, total, mean, std), s = _advance(s, t[i:j], x[i:j])
        yield pd.DataFrame({"tx_id": ids[i:j], "account_id": key[0], "prior_count": n, "prior_sum": total,
                            "prior_mean": mean, "prior_std": std})
    state.update(s)
    if expire_us is not None:
        # a time-out must lie ahead of the watermark
        state.setTimeoutTimestamp(max((s[4] + expire_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def account_running_state(stream: DataFrame, key: str = "sender_account", amount: str = "amount_paid",
                          expire_after: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """ST-6: per account, count / sum / mean / sample std of all its strictly earlier transfers, emitted
    with each transfer; transfers of one timestamp do not see each other, also across batches. A missing
    amount is not counted. State is (n, sum, mean, M2) of the rows before the account's latest timestamp
    and of the rows at it, merged across batches with the parallel-variance formula; batch prefixes are
    numpy cumulative sums, so there is no per-row Python loop. A transfer that arrives in a later batch
    than a newer one of its account sees the rows already taken in before that newer one.

    ``expire_after`` (an interval such as "30 days") bounds the state: a transfer more than that after the
    account's previous one starts anew, however the transfers fall into batches, and a timer drops the
    state of an account once the watermark is that far past its latest transfer. Without it state is
    kept for good, which is what equals the whole-history batch form."""
    s = (stream.where(F.col("ts").isNotNull())
         .select("tx_id", "ts", F.col(key).alias("_k"), F.unix_micros("ts").alias("_t"),
                 F.col(amount).cast("double").alias("_x")))
    if expire_after is None:
        return s.drop("ts").groupBy("_k").applyInPandasWithState(_running, RUNNING_SCHEMA, RUNNING_STATE, "append",
                                                                 GroupStateTimeout.NoTimeout)
    expire_us = int(pd.Timedelta(expire_after).total_seconds() * 1_000_000)

    def expiring(k, pdfs, state):
        yield from _running(k, pdfs, state, expire_us)

    return s.withWatermark("ts", watermark).groupBy("_k").applyInPandasWithState(
        expiring, RUNNING_SCHEMA, RUNNING_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def dedup_transactions(stream: DataFrame, watermark: str = "24 hours", key: str = "tx_id") -> DataFrame:
    """ST-7: drop repeated transaction ids arriving within the watermark delay."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def drift_microbatch(features: DataFrame, fitted: DataFrame, path: str, checkpoint: str, window: int = 1,
                     trigger: dict | None = None):
    """ST-8: drift of the last ``window`` micro-batches, that one included, against a fitted reference
    histogram (``drift.fit_histogram``), one row per feature and batch under ``path``/psi.

    A batch is counted once into the reference's bins and its counts are kept under ``path``/cells; the
    window's histogram is the sum of the last counts, so neither the reference nor earlier batches are
    read again. Both folders are named by batch id: a replayed batch replaces its own."""
    edges = DR.edges_of(fitted)

    def sink(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        folder = lambda kind, k: os.path.join(path, kind, f"batch_id={k}")
        DR.count_cells(batch, edges).coalesce(1).write.mode("overwrite").parquet(folder("cells", batch_id))
        last = [folder("cells", k) for k in range(max(0, batch_id - window + 1), batch_id + 1)]
        merged = DR.merge_cells(spark.read.schema(DR.CELLS).parquet(*last))
        DR.feature_drift(DR.psi_of(fitted, merged)).coalesce(1).write.mode("overwrite").parquet(folder("psi", batch_id))

    w = features.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


# --- running a stream to a table -------------------------------------------------------------------

def run_to_table(df: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None,
                 trigger: dict | None = None) -> DataFrame:
    """Run a streaming plan until the available input is consumed and return its result as a
    static DataFrame read back from the shared checkpoint folder. ``update`` mode keeps, per
    ``keys``, the row of the latest batch (an upsert log)."""
    spark = df.sparkSession
    base = scratch_path(spark, f"stream-{name}")
    out, ck = os.path.join(base, "out"), os.path.join(base, "checkpoint")
    if mode == "append":
        q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
             .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(out)

    def sink(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(os.path.join(out, f"_batch={batch_id}"))

    q = (df.writeStream.foreachBatch(sink).option("checkpointLocation", ck).outputMode(mode)
         .trigger(**(trigger or {"availableNow": True})).start())
    q.awaitTermination()
    log = spark.read.parquet(out)
    w = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_batch")
