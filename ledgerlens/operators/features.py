"""Per-transaction and per-account features (PRJ-1..12, AGG-1..4, AGG-7..9, AGG-13, JOIN-1,
WIN-1, WIN-3, WIN-4).

Shuffle plan of ``feature_table`` on a cluster: one partial+final aggregation per account
side (map-side combine, so a hot account costs one row per map task), the distinct-pair
counts pre-aggregated on (account, counterparty) before the account-level count, and two
joins of the transaction table with the per-account profiles. AQE broadcasts a profile when
its measured size is small and otherwise sort-merges with skew-join splitting of hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.operators.graph import ordered_index
from ledgerlens.operators.lookup import lookup, null_safe_join
from ledgerlens.session import cut_lineage

# Model feature names and order (must equal the reference's).
FEATURE_COLUMNS = [
    "hour", "day_of_week", "is_weekend", "day_of_month",
    "log_amount_paid", "log_amount_received", "log_amount_ratio",
    "is_cross_currency", "payment_currency_enc", "receiving_currency_enc",
    "payment_format_enc", "is_cross_bank",
    "sender_tx_count", "sender_total_amount", "sender_mean_amount", "sender_std_amount",
    "receiver_tx_count", "receiver_total_amount", "receiver_mean_amount",
    "sender_receiver_diversity", "receiver_sender_diversity",
]
# Fixed value: payment format used for a missing format before encoding.
UNKNOWN_FORMAT = "Unknown"

MONEY_SUM = "decimal(38,10)"
MONEY_DEC = "decimal(28,10)"    # sums of amounts are exact to 10 decimals (small coins included)


# --- projections ------------------------------------------------------------------------

def time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """PRJ-1..4."""
    return (df.withColumn("hour", C.hour_of(ts))
              .withColumn("day_of_week", C.day_of_week(ts))
              .withColumn("is_weekend", C.is_weekend(ts))
              .withColumn("day_of_month", C.day_of_month(ts)))


def amount_features(df: DataFrame) -> DataFrame:
    """PRJ-5..8 on already-typed amounts (PRJ-5 coercion: NULL/NaN -> 0)."""
    return (df.withColumn("amount_paid", C.coerce_amount("amount_paid"))
              .withColumn("amount_received", C.coerce_amount("amount_received"))
              .withColumn("log_amount_paid", C.log1p_amount("amount_paid"))
              .withColumn("log_amount_received", C.log1p_amount("amount_received"))
              .withColumn("amount_ratio", C.amount_ratio("amount_paid", "amount_received"))
              .withColumn("log_amount_ratio", C.log_amount_ratio("amount_ratio"))
              .withColumn("bad_amount", F.greatest(C.bad_amount("amount_paid"), C.bad_amount("amount_received"))))


def cross_flags(df: DataFrame) -> DataFrame:
    """PRJ-9/10: 1 when the two sides differ (a NULL on either side counts as different)."""
    return (df.withColumn("is_cross_currency", C.differs("payment_currency", "receiving_currency"))
              .withColumn("is_cross_bank", C.differs("from_bank", "to_bank")))


# --- dictionaries (PRJ-11/12, AGG-13) ------------------------------------------------------

def category_values(df: DataFrame) -> DataFrame:
    """AGG-13: the distinct (kind, value) of both currency columns (kind ``currency``) and of the
    payment format (kind ``format``, a missing one is ``Unknown``), in one scan."""
    kinds = F.array(
        F.struct(F.lit("currency").alias("kind"), F.col("payment_currency").cast("string").alias("value")),
        F.struct(F.lit("currency").alias("kind"), F.col("receiving_currency").cast("string").alias("value")),
        F.struct(F.lit("format").alias("kind"), _format_or_unknown().alias("value")))
    return df.select(F.inline(kinds)).where(F.col("value").isNotNull()).distinct()


def _format_or_unknown() -> Column:
    return F.coalesce(F.col("payment_format").cast("string"), F.lit(UNKNOWN_FORMAT))


def fit_dictionaries(df: DataFrame) -> DataFrame:
    """PRJ-11/12: (kind, value, code), codes 0..k-1 by binary string order within each kind.

    The result is a written table: it is fitted once, kept with the model, and its size is known
    to the planner when it is joined."""
    vals = cut_lineage(category_values(df))
    parts = [ordered_index(vals.where(F.col("kind") == kind), "value", "code")
             .select(F.lit(kind).alias("kind"), "value", F.col("code").cast("int")) for kind in ("currency", "format")]
    return cut_lineage(parts[0].unionByName(parts[1]))


def encode_categories(df: DataFrame, dictionaries: DataFrame | None = None) -> DataFrame:
    """PRJ-11/12: one shared currency dictionary for both currency columns, one for formats;
    values absent from the dictionary get -1. Without ``dictionaries`` they are fitted on ``df``."""
    d = dictionaries if dictionaries is not None else fit_dictionaries(df)
    cur, fmt = d.where(F.col("kind") == "currency"), d.where(F.col("kind") == "format")
    out = lookup(df, "payment_currency", cur, "value", "code", "payment_currency_enc", -1)
    out = lookup(out, "receiving_currency", cur, "value", "code", "receiving_currency_enc", -1)
    return lookup(out, _format_or_unknown(), fmt, "value", "code", "payment_format_enc", -1)


# --- account aggregates (AGG-1..4) -----------------------------------------------------------

def _pair_counts(df: DataFrame, key: str, other: str, out: str) -> DataFrame:
    """Distinct counterparties per account in two exchanges: (key, other) pairs first, so a hot
    account's pairs are spread over many tasks, then a partially aggregated count per key."""
    ends = sorted((key, other))     # one order for both ends, so that a plan with both moves the pairs once
    pairs = df.where(F.col(ends[0]).isNotNull() & F.col(ends[1]).isNotNull()).select(*ends).distinct()
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias(out))


def sender_profile(df: DataFrame) -> DataFrame:
    """AGG-1 + AGG-3: per sender count, exact sum, mean, sample std of paid; distinct receivers."""
    stats = (df.where(F.col("sender_account").isNotNull()).groupBy("sender_account").agg(
        F.count(F.lit(1)).alias("sender_tx_count"),
        F.sum(F.col("amount_paid").cast(MONEY_DEC)).alias("_s"),
        F.stddev_samp("amount_paid").alias("_sd")))
    stats = stats.select(
        "sender_account", "sender_tx_count",
        C.fixed(F.col("_s").cast("double"), 4).alias("sender_total_amount"),
        C.fixed(F.col("_s").cast("double") / F.col("sender_tx_count"), 6).alias("sender_mean_amount"),
        C.fixed(F.coalesce(F.col("_sd"), F.lit(0.0)), 4).alias("sender_std_amount"))
    div = _pair_counts(df, "sender_account", "receiver_account", "sender_receiver_diversity")
    return stats.join(div, "sender_account", "left").fillna(0, ["sender_receiver_diversity"])


def receiver_profile(df: DataFrame) -> DataFrame:
    """AGG-2 + AGG-4: per receiver count, exact sum, mean of received; distinct senders."""
    stats = (df.where(F.col("receiver_account").isNotNull()).groupBy("receiver_account").agg(
        F.count(F.lit(1)).alias("receiver_tx_count"),
        F.sum(F.col("amount_received").cast(MONEY_DEC)).alias("_s")))
    stats = stats.select(
        "receiver_account", "receiver_tx_count",
        C.fixed(F.col("_s").cast("double"), 4).alias("receiver_total_amount"),
        C.fixed(F.col("_s").cast("double") / F.col("receiver_tx_count"), 6).alias("receiver_mean_amount"))
    div = _pair_counts(df, "receiver_account", "sender_account", "receiver_sender_diversity")
    return stats.join(div, "receiver_account", "left").fillna(0, ["receiver_sender_diversity"])


SENDER_COLS = ["sender_tx_count", "sender_total_amount", "sender_mean_amount", "sender_std_amount",
               "sender_receiver_diversity"]
RECEIVER_COLS = ["receiver_tx_count", "receiver_total_amount", "receiver_mean_amount",
                 "receiver_sender_diversity"]
PROFILE_COLS = {"sender": SENDER_COLS, "receiver": RECEIVER_COLS}


def attach_profiles(df: DataFrame, sender: DataFrame, receiver: DataFrame) -> DataFrame:
    """JOIN-1: two left joins (profiles already fold AGG-1+3 and AGG-2+4), 0-filled."""
    return attach_profile(attach_profile(df, sender, "sender"), receiver, "receiver")


def attach_profile(df: DataFrame, profile: DataFrame, end: str) -> DataFrame:
    """One of the two joins of JOIN-1."""
    out = df.join(profile, f"{end}_account", "left")
    for c in PROFILE_COLS[end]:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast(out.schema[c].dataType)))
    return out


def fit_profiles(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AGG-1..4 as kept with a model: the sender and the receiver profiles of ``tx``."""
    f = amount_features(tx)
    return cut_lineage(sender_profile(f)), cut_lineage(receiver_profile(f))


def engineer_features(tx: DataFrame, point_in_time: bool = False, dictionaries: DataFrame | None = None,
                      profiles: tuple[DataFrame, DataFrame] | None = None, ends: tuple[str, ...] = ("sender", "receiver"),
                      again: DataFrame | None = None) -> DataFrame:
    """The feature table: one row per transaction with the 21 model features.

    ``dictionaries`` and ``profiles``: what ``fit_dictionaries`` and ``fit_profiles`` returned for the
    training data (unseen categories are -1, unknown accounts 0); without them they come from ``tx``.

    ``point_in_time=False``: account aggregates are global (every row sees the whole table,
    later rows included), as in the reference. ``True``: the same columns are computed from
    strictly earlier transactions only (``point_in_time_profiles``, see there for ``ends`` and
    ``again``), which removes that look-ahead.
    """
    d = dictionaries if dictionaries is not None else fit_dictionaries(tx)
    # codes and flags take less room than the texts they are made of; features made before would be moved with the rows
    out = encode_categories(cross_flags(tx), d)
    if not point_in_time:
        # profiles are written first, so that what was shuffled for them is gone by then
        out = attach_profiles(out, *(profiles or fit_profiles(tx)))
    else:
        out = point_in_time_profiles(out, ends, again)
        for c in (c for end in ends for c in PROFILE_COLS[end]):
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast(out.schema[c].dataType)))
    return amount_features(time_features(out))


HOT_ROWS = 1_000_000     # rows of one account (or of accounts of one hash) above which its history is cut into days
HOT_CELLS = 1 << 16


def repeated_ids(df: DataFrame, id_col: str = "tx_id") -> DataFrame:
    """(_h): the 64-bit hashes that several rows' ids have, as a written table. Ids of the other hashes are alone."""
    return cut_lineage(df.where(F.col(id_col).isNotNull()).groupBy(F.xxhash64(id_col).alias("_h"))
                       .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_h"))


def point_in_time_profiles(tx: DataFrame, ends: tuple[str, ...] = ("sender", "receiver"),
                           again: DataFrame | None = None) -> DataFrame:
    """``tx`` with the profile columns of ``ends`` over strictly earlier transactions (null where there are none
    of an account): the histories of the ends joined by id. A row is moved once to each end's account and takes
    its history along; only ids that come again (``again``: their ``repeated_ids``) are joined."""
    of = {"sender": ("sender_account", "amount_paid", "receiver_account"),
          "receiver": ("receiver_account", "amount_received", "sender_account")}
    out = tx
    for end in ends:
        key, amount, other = of[end]
        out = with_history(out, key, C.coerce_amount(amount), other, end, PROFILE_COLS[end][-1], tx)
    cols = [c for end in ends for c in PROFILE_COLS[end]]
    out = out.select(*tx.columns, *cols)
    if not tx.where(F.col("tx_id").isNull()).isEmpty():      # a row without an id is joined to nothing
        out = out.select(*tx.columns, *[F.when(F.col("tx_id").isNotNull(), F.col(c)).alias(c) for c in cols])
    again = repeated_ids(tx) if again is None else again
    if again.isEmpty():
        return out
    hashed = out.withColumn("_h", F.xxhash64("tx_id"))
    rows = cut_lineage(hashed.join(again, "_h", "left_semi").drop("_h"))
    joined = rows.select(*tx.columns)
    for end in ends:
        there = F.col(of[end][0]).isNotNull() & F.col("ts").isNotNull()
        joined = joined.join(rows.where(there).select("tx_id", *PROFILE_COLS[end]), "tx_id", "left")
    return hashed.join(again, "_h", "left_anti").select(*out.columns).unionByName(joined.select(*out.columns))


def with_history(df: DataFrame, key: str, amount: Column, other: str, prefix: str, diversity: str,
                 counted: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """``history_stats`` as further columns of ``df``'s own rows (null without a key or a time). A row is moved once, to its
    account, where sorts by counterparty and by time make all columns. Accounts with over HOT_ROWS rows, found by counts per
    hash cell, go through ``history_stats``, which spreads them by days.
    ``counted``: the same rows nearer to their source, where counting them moves no row."""
    there = F.col(key).isNotNull() & F.col(ts).isNotNull()
    cell = F.when(there, F.pmod(F.xxhash64(key), F.lit(HOT_CELLS)).cast("int")).otherwise(F.lit(-1))
    # at most rows / HOT_ROWS numbers
    hot = [r["c"] for r in (counted or df).groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n"))
           .where(F.col("n") > HOT_ROWS).select("c").collect()]
    many = cell.isin([c for c in hot if c >= 0])
    base = (df.where(~many) if max(hot, default=-1) >= 0 else df).withColumn("_z", F.when(there, F.lit(0)).otherwise(
        F.lit(1) + F.pmod(F.xxhash64(other, ts, key), F.lit(HOT_CELLS)).cast("int")))
    # rows without a history are dealt over all tasks where they are many
    base = base.repartition("_z", key) if -1 in hot else base.repartition(key)
    base = base.withColumn("_t", F.unix_micros(F.col(ts))).withColumn("_x", amount.cast("double"))
    account = Window.partitionBy("_z", key)
    first = Window.partitionBy("_z", key, other).orderBy("_t")
    base = (base.withColumn("_m", (F.col(other).isNotNull() & (F.row_number().over(first) == 1)).cast("int"))
            .withColumn("_d", F.col("_x") - F.avg("_x").over(account)))
    earlier = account.orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c.over(earlier), F.lit(0))
    n, sm, m = F.count(F.lit(1)).over(earlier), zero(F.sum(F.col("_x").cast(MONEY_DEC))), zero(F.sum("_m"))
    q, d = zero(F.sum(F.col("_d") * F.col("_d"))), zero(F.sum("_d"))
    run = base.select(*df.columns, "_z", n.alias("_n"), sm.alias("_s"), q.alias("_q"), d.alias("_dd"), m.alias("_mm"))
    stats = _history_columns(*[F.col(c) for c in ("_n", "_s", "_q", "_dd", "_mm")], prefix, diversity)
    own = [F.when(F.col("_z") == 0, c).alias(name) for name, c in stats.items()]
    out = run.select(*df.columns, *own)
    if max(hot, default=-1) >= 0:
        rows = df.where(many).withColumn("_row", F.struct(*df.columns)).withColumn("_amount", amount)
        h = history_stats(rows, key, "_amount", other, prefix, diversity, id_col="_row", ts=ts)
        out = out.unionByName(h.select("_row.*", *stats))
    return out


def _history_columns(n: Column, total: Column, q: Column, d: Column, m: Column, prefix: str, diversity: str) -> dict[str, Column]:
    """The columns of a history from its count, exact sum, sums of squared and of plain distances, and counterparties."""
    sd = total.cast("double")
    var = F.when(n > 1, F.greatest((q - d * d / n.cast("double")) / (n - 1).cast("double"), F.lit(0.0)))
    return {
        f"{prefix}_tx_count": n.cast("long"),
        f"{prefix}_total_amount": C.fixed(sd, 4),
        f"{prefix}_mean_amount": C.fixed(F.coalesce(F.try_divide(sd, n.cast("double")), F.lit(0.0)), 6),
        f"{prefix}_std_amount": C.fixed(F.coalesce(F.sqrt(var), F.lit(0.0)), 4),
        diversity: m.cast("long")}


def history_stats(df: DataFrame, key: str, amount: str, other: str, prefix: str, diversity: str,
                  id_col: str = "tx_id", ts: str = "ts", bucket_us: int = 86_400 * 1_000_000) -> DataFrame:
    """WIN-1 over the whole history: per transaction, count / exact sum / mean / sample std of
    ``amount`` and the number of distinct ``other`` over the same ``key``'s strictly earlier
    transactions (same timestamp = not earlier).

    Distinct counterparties come from first-seen markers: one row per (key, other) at the time
    the pair first appears. Skew: running sums are split by (key, time bucket) — the window
    runs inside a bucket, and the totals of all earlier buckets come from a table with one row
    per (key, bucket) — so a hot account is spread over as many tasks as it has buckets.
    The variance uses the sums of d and d^2 (doubles), d being the distance to the account's mean amount, so
    large amounts close together do not cancel, and is clamped at 0."""
    base = df.select(F.col(id_col).alias("_id"), F.col(key).alias("_k"), F.col(other).alias("_o"),
                     F.unix_micros(F.col(ts)).alias("_t"), F.col(amount).cast("double").alias("_x")) \
        .where(F.col("_k").isNotNull() & F.col("_t").isNotNull())
    centre = base.groupBy("_k").agg(F.avg("_x").alias("_c"))
    base = base.join(centre, "_k").withColumn("_d", F.col("_x") - F.col("_c")).drop("_c")
    first = base.where(F.col("_o").isNotNull()).groupBy("_k", "_o").agg(F.min("_t").alias("_t"))
    dec = MONEY_DEC
    none = F.lit(None).cast("double")
    rows = (base.select("_id", "_k", "_t", "_x", "_d", F.lit(1).alias("_n"), F.lit(0).alias("_m"))
            .unionByName(first.select(F.lit(None).cast(df.schema[id_col].dataType).alias("_id"), "_k", "_t",
                                      none.alias("_x"), none.alias("_d"), F.lit(0).alias("_n"), F.lit(1).alias("_m")))
            .withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_us))))
    tot = rows.groupBy("_k", "_b").agg(F.sum("_n").alias("_bn"), F.sum(F.col("_x").cast(dec)).alias("_bs"),
                                       F.sum(F.col("_d") * F.col("_d")).alias("_bq"), F.sum("_d").alias("_bd"),
                                       F.sum("_m").alias("_bm"))
    wb = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_k", "_b", *[F.sum(c).over(wb).alias("_o" + c[2:]) for c in ("_bn", "_bs", "_bq", "_bd", "_bm")])
    wi = Window.partitionBy("_k", "_b").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    inb = rows.select("_id", "_k", "_b", "_n",
                      F.sum("_n").over(wi).alias("_ln"), F.sum(F.col("_x").cast(dec)).over(wi).alias("_ls"),
                      F.sum(F.col("_d") * F.col("_d")).over(wi).alias("_lq"), F.sum("_d").over(wi).alias("_ld"),
                      F.sum("_m").over(wi).alias("_lm")) \
        .where(F.col("_n") == 1)
    j = inb.join(off, ["_k", "_b"])
    z = lambda a, b: F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))
    n, sm, q, d, m = z("_on", "_ln"), z("_os", "_ls"), z("_oq", "_lq"), z("_od", "_ld"), z("_om", "_lm")
    return j.select(F.col("_id").alias(id_col),
                    *[c.alias(name) for name, c in _history_columns(n, sm, q, d, m, prefix, diversity).items()])


def feature_matrix_columns(df: DataFrame) -> list[str]:
    missing = [c for c in FEATURE_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"feature columns missing: {missing}")
    return list(FEATURE_COLUMNS)


# --- class balance, scaler (AGG-7..9) -------------------------------------------------------

def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """AGG-7: positives, negatives and the positive-class weight n_neg / max(n_pos, 1)."""
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    return df.agg(pos.alias("n_pos"), neg.alias("n_neg"),
                  C.fixed(neg.cast("double") / F.greatest(pos, F.lit(1)).cast("double"), 6).alias("pos_weight"))


def scaler_fit(df: DataFrame, cols: list[str]) -> DataFrame:
    """AGG-8: one row of mean and population std per column (a single partial+final agg)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}__mean"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__std")]
    return df.agg(*aggs)


def scaler_stats(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """The fitted scaler as {col: (mean, scale)}; one bounded row is collected."""
    row = scaler_fit(df, cols).first()
    out = {}
    for c in cols:
        m, s = row[f"{c}__mean"], row[f"{c}__std"]
        out[c] = (m if m is not None else 0.0, s if s not in (None, 0.0) else 1.0)
    return out


def scaler_apply(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """AGG-9: (x - mean) / scale with the scale of a constant column fixed to 1."""
    out = df
    for c, (m, s) in stats.items():
        out = out.withColumn(c + suffix, (F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s)))
    return out


# --- splits (WIN-3, WIN-4) ----------------------------------------------------------------------

def _hash_order(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def _ranked_in_buckets(df: DataFrame, group: list[str], order: Column, key: str, bucket_hex: int) -> DataFrame:
    """Global rank of ``order`` within ``group`` without a single-partition window.

    Rows are hashed into 16**bucket_hex order-preserving buckets (the hash prefix); the rank
    inside a bucket comes from a window partitioned by (group, bucket), and a small table of
    bucket offsets (at most |groups| x 16**bucket_hex rows, a fixed bound) is broadcast. Rows are moved to
    their buckets without the hash, which is made again there."""
    b = df.withColumn("_b", F.conv(F.substring(order, 1, bucket_hex), 16, 10).cast("int"))
    keys = group + ["_b"]
    in_bucket = Window.partitionBy(*keys).orderBy("_h", key)
    local = b.repartition("_b").withColumn("_h", order).withColumn("_r", F.row_number().over(in_bucket))
    counts = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    wg = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    offsets = counts.select(
        *keys,
        F.coalesce(F.sum("_c").over(wg.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_off"),
        F.sum("_c").over(wg).alias("_n"))
    return (null_safe_join(local, F.broadcast(offsets), keys)
            .withColumn("_rank", F.col("_off") + F.col("_r"))
            .drop("_b", "_r", "_off"))


def stratified_split(df: DataFrame, test_frac: float = 0.2, seed: int = 42, key: str = "tx_id",
                     label: str = "label", bucket_hex: int = 4) -> DataFrame:
    """WIN-3: per label, the first ceil(frac * n_label) rows in seeded-hash order are test."""
    r = _ranked_in_buckets(df, [label], _hash_order(seed, key), key, bucket_hex)
    return r.withColumn("is_test", (F.col("_rank") <= F.ceil(F.col("_n") * F.lit(float(test_frac)))).cast("int")) \
            .drop("_h", "_rank", "_n")


def random_split(df: DataFrame, test_frac: float = 0.2, seed: int = 7, key: str = "tx_id",
                 bucket_hex: int = 4) -> DataFrame:
    """WIN-4: floor(frac * m) rows in seeded-hash order are test, no stratification."""
    r = _ranked_in_buckets(df, [], _hash_order(seed, key), key, bucket_hex)
    return r.withColumn("is_test", (F.col("_rank") <= F.floor(F.col("_n") * F.lit(float(test_frac)))).cast("int")) \
            .drop("_h", "_rank", "_n")


# --- point-in-time rolling features (WIN-1) ----------------------------------------------------

DAY_US = 86_400 * 1_000_000


# Length of a segment of time, in widest windows, and new rows that a task goes through at once.
SEGMENT_WINDOWS = 8
CHUNK_ROWS = 1 << 16


def _first_at_least(values: np.ndarray, least: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Per row, the first position in [low, high) whose value is at least ``least``, or ``high``; values
    ascend there."""
    low, high = low.copy(), high.copy()
    while (searching := low < high).any():
        mid = (low + high) // 2
        less = searching & (values[np.where(searching, mid, 0)] < least)
        low, high = np.where(less, mid + 1, low), np.where(searching & ~less, mid, high)
    return low


def _merge_states(a: tuple, b: tuple) -> tuple:
    """(count, mean, squared deviations, maximum) of two disjoint sets, without cancellation."""
    n, d = a[0] + b[0], b[1] - a[1]
    share = b[0] / np.maximum(n, 1)
    return n, a[1] + d * share, a[2] + b[2] + d * d * a[0] * share, np.maximum(a[3], b[3])


def _range_states(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """(mean, squared deviations, maximum) of the numbers of ``x`` in every range: a range is a sum of
    ranges whose lengths are powers of two, and these are made by doubling."""
    none = np.isnan(x)
    table = (1.0 - none, np.where(none, 0.0, x), np.zeros(len(x)), np.where(none, -np.inf, x))
    out = [np.zeros(len(low)), np.zeros(len(low)), np.zeros(len(low)), np.full(len(low), -np.inf)]
    at, length, size = low.copy(), high - low, 1
    longest = int(length.max(initial=0))
    while size <= longest:
        here = np.flatnonzero(length & size)
        for o, v in zip(out, _merge_states([o[here] for o in out], [v[at[here]] for v in table])):
            o[here] = v
        at[here] += size
        table = _merge_states([v[:-size] for v in table], [v[size:] for v in table])
        size *= 2
    return out[1:]


def _counterparties(o: np.ndarray, t: np.ndarray, seg: np.ndarray, begin: np.ndarray, end: np.ndarray, rows: np.ndarray,
                    earlier: np.ndarray, widths: list[int | None]) -> list[np.ndarray]:
    """Per width, the number of distinct ``o`` (-1: none) in the windows of ``rows``: a transfer stands for its
    counterparty until the pair's next transfer or its own expiry, so it counts the transfers that have begun
    and not ended."""
    some = np.flatnonzero(o >= 0)
    before = np.concatenate([[0], np.cumsum(o >= 0)])
    order = some[np.lexsort((t[some], o[some], seg[some]))]
    never = np.iinfo(np.int64).max
    following = np.full(len(t), never)
    same = (o[order[1:]] == o[order[:-1]]) & (seg[order[1:]] == seg[order[:-1]])
    following[order[:-1][same]] = t[order[1:][same]]
    first = before[begin[rows]]
    out = []
    for w in widths:
        ends = following[some] if w is None else np.minimum(following[some], t[some] + w)
        ends = ends[np.lexsort((ends, seg[some]))]
        ended = _first_at_least(ends, t[rows], first, before[end[rows]]) if len(ends) else first
        out.append(before[earlier] - ended)
    return out


def _window_rows(widths: list[int | None], with_other: bool):
    """Rows of segments in order of time to (_id, n, h, l, e, v, x, d of every width): count, whole and
    decimal part of the sum, mean, squared deviations, maximum and distinct counterparties over the
    strictly earlier rows in the window. Only the rows that lie in the widest window of a segment's
    latest row are kept between chunks."""
    widest = None if None in widths else max(widths)

    def take(table: pa.Table, old: int) -> tuple[pa.RecordBatch, pa.Table]:
        col = lambda c: table.column(c).combine_chunks()
        t = col("_t").to_numpy(zero_copy_only=False)
        key = col("_k").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        g = col("_g").to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero((np.diff(key) != 0) | (np.diff(g) != 0)) + 1])
        sizes = np.diff(np.concatenate([starts, [len(t)]]))
        seg = np.repeat(np.arange(len(starts)), sizes)
        begin, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
        rows = np.flatnonzero(col("_own").to_numpy(zero_copy_only=False))
        rows = rows[rows >= old]
        first = begin[rows]
        high = _first_at_least(t, t[rows], first, rows)
        lows = [first if w is None else _first_at_least(t, t[rows] - w, first, high) for w in widths]
        x = col("_x").to_numpy(zero_copy_only=False).astype(float)
        there = col("_x").is_valid().to_numpy(zero_copy_only=False)
        run = lambda v: np.concatenate([[0], np.cumsum(v)])
        sums = [run(there), *[run(col(c).fill_null(0).to_numpy(zero_copy_only=False)) for c in ("_h", "_l")]]
        mean, dev, top = (v.reshape(len(widths), -1) for v in _range_states(x, np.concatenate(lows), np.tile(high, len(widths))))
        distinct = None
        if with_other:
            o = col("_o").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            distinct = _counterparties(o, t, seg, begin, end, rows, high, widths)
        cols = [col("_id").take(pa.array(rows))]
        for i, low in enumerate(lows):
            n, h, part = (s[high] - s[low] for s in sums)
            nothing = n == 0
            cols += [pa.array(n), pa.array(h), pa.array(part), *[pa.array(v[i], mask=nothing) for v in (mean, dev, top)]]
            cols.append(pa.array(distinct[i]) if with_other else pa.nulls(len(rows), pa.int64()))
        names = ["_id", *[f"{c}{i}" for i in range(len(widths)) for c in "nhlevxd"]]
        kept = int(starts[-1])
        if widest is not None:
            kept = int(np.searchsorted(t[kept:], t[-1] - widest)) + kept
        return pa.RecordBatch.from_arrays(cols, names=names), table.slice(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, new, n_new = None, [], 0
        for b in batches:
            if b.num_rows:
                new.append(b)
                n_new += b.num_rows
            # as many new rows as kept ones at least, so that a long window is not gone through for a few rows
            if n_new >= max(CHUNK_ROWS, kept.num_rows if kept else 0):
                out, kept = take(_joined_rows(kept, new), kept.num_rows if kept else 0)
                new, n_new = [], 0
                yield out
        if new:
            yield take(_joined_rows(kept, new), kept.num_rows if kept else 0)[0]

    return run


def _joined_rows(kept: pa.Table | None, new: list[pa.RecordBatch]) -> pa.Table:
    t = pa.Table.from_batches(new)
    return t if kept is None else pa.concat_tables([kept, t]).combine_chunks()


def rolling_window_stats(df: DataFrame, key: str, amount: str, windows: dict[str, int | None],
                         id_col: str = "tx_id", ts: str = "ts", prefix: str = "", split: int = 1,
                         other: str | None = None) -> DataFrame:
    """Count / exact sum / mean / sample std / max of ``amount``, and the number of distinct ``other``
    if given (``div``), over rows of the same ``key`` strictly earlier than each row, for every
    (name -> width in microseconds) in ``windows``. ``id_col`` tells rows apart; rows without a key
    or a time have no window and are left out.

    A row is moved once for all windows, to its account and segment of time (SEGMENT_WINDOWS / ``split``
    widest windows long); rows within the widest window of a segment's end go to the next one too. So a
    hot account is spread over as many tasks as it has segments. A task goes through its sorted rows in
    chunks; a window is a range of them, whose sums are differences of running sums and whose deviations
    and maximum are merged from ranges of power-of-two lengths, so the work grows with the rows times the
    logarithm of the rows in a window. A width must be a multiple of ``split``; a width of None is the
    whole history (one segment per key; ``history_stats`` is the skew-safe form of that case).
    """
    split = max(1, int(split))
    widths = list(windows.values())
    if any(w is not None and w % split for w in widths):
        raise ValueError("every width must be a multiple of split")
    base = df.select(F.col(id_col).alias("_id"), F.col(key).alias("_k"), F.unix_micros(F.col(ts)).alias("_t"),
                     F.col(amount).cast("double").alias("_x"), *([F.col(other).alias("_o")] if other else [])) \
        .where(F.col("_k").isNotNull() & F.col("_t").isNotNull())
    if None in widths:
        moved = base.withColumn("_g", F.lit(0).cast("long")).withColumn("_own", F.lit(True))
    else:
        span = max(widths) * max(1, SEGMENT_WINDOWS // split)
        into = F.pmod(F.col("_t"), F.lit(span))
        g = ((F.col("_t") - into) / F.lit(span)).cast("long")
        place = lambda g, own: F.struct(g.alias("g"), F.lit(own).alias("own"))
        moved = base.withColumn("_e", F.explode(F.when(into >= span - max(widths), F.array(place(g, True), place(g + 1, False)))
                                                .otherwise(F.array(place(g, True)))))
        moved = moved.withColumn("_g", F.col("_e.g")).withColumn("_own", F.col("_e.own")).drop("_e") \
            .withColumn("_id", F.when(F.col("_own"), F.col("_id")))
    exact = F.col("_x").cast(MONEY_DEC)
    ordered = (moved.repartition("_k", "_g").sortWithinPartitions("_k", "_g", "_t")
               .withColumn("_h", F.floor(exact).cast("long"))
               .withColumn("_l", ((exact - F.floor(exact)) * F.lit(10 ** 10)).cast("long")))
    kinds = {"n": "long", "h": "long", "l": "long", "e": "double", "v": "double", "x": "double", "d": "long"}
    id_type = df.schema[id_col].dataType.simpleString()
    parts = ordered.mapInArrow(_window_rows(widths, bool(other)), f"_id {id_type}, " + ", ".join(
        f"{c}{i} {kind}" for i in range(len(widths)) for c, kind in kinds.items()))
    # rows of one id count together
    aggs, out = [], []
    for i, name in enumerate(windows):
        c = {k: F.col(f"{k}{i}") for k in kinds}
        s = c["h"].cast("decimal(28,10)") + c["l"].cast("decimal(20,0)") * F.lit("0.0000000001").cast("decimal(11,10)")
        weighted = c["n"].cast("double") * c["e"]
        far = F.sum(weighted * c["e"]) - F.sum(weighted) * F.sum(weighted) / F.sum(c["n"]).cast("double")
        between = F.when(F.min(c["e"]) == F.max(c["e"]), F.lit(0.0)).otherwise(F.greatest(far, F.lit(0.0)))
        aggs += [F.sum(c["n"]).alias(f"n{i}"), F.sum(s).cast("double").alias(f"s{i}"), F.max(c["x"]).alias(f"x{i}"),
                 (F.sum(c["v"]) + between).alias(f"v{i}"), F.max(c["d"]).alias(f"d{i}")]
        n, total = F.col(f"n{i}"), F.col(f"s{i}")
        std = F.when(n > 1, F.sqrt(F.col(f"v{i}") / (n - 1).cast("double")))
        out += [
            n.alias(f"{prefix}cnt_{name}"),
            C.fixed(total, 4).alias(f"{prefix}sum_{name}"),
            C.fixed(F.coalesce(F.try_divide(total, n.cast("double")), F.lit(0.0)), 6).alias(f"{prefix}mean_{name}"),
            C.fixed(F.coalesce(std, F.lit(0.0)), 4).alias(f"{prefix}std_{name}"),
            F.coalesce(F.col(f"x{i}"), F.lit(0.0)).alias(f"{prefix}max_{name}"),
        ]
        if other:
            out.append(F.col(f"d{i}").cast("long").alias(f"{prefix}div_{name}"))
    return parts.repartition("_id").groupBy("_id").agg(*aggs).select(F.col("_id").alias(id_col), *out)


def rolling_account_features(df: DataFrame, windows: dict[str, int | None] | None = None, split: int = 1,
                             counterparties: bool = False) -> DataFrame:
    """WIN-1 for both ends of each transaction (sender: paid, receiver: received), keyed by
    tx_id, over strictly earlier transfers inside each window, on request with the number of distinct
    counterparties. Whole-history statistics are ``history_stats`` /
    ``engineer_features(point_in_time=True)``."""
    windows = windows or {"1d": DAY_US, "7d": 7 * DAY_US, "30d": 30 * DAY_US}
    ends = [("sender_account", "amount_paid", "sender_", "receiver_account"),
            ("receiver_account", "amount_received", "receiver_", "sender_account")]
    s, r = (rolling_window_stats(df, key, amount, windows, prefix=prefix, split=split, other=other if counterparties else None)
            for key, amount, prefix, other in ends)
    return s.join(r, "tx_id", "full")
