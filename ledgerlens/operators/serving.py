"""Account features at serving time (SNK-1 with ML-10 / ST-2): a stored history of daily profiles and
its join to requests as of their day.

``profile_history`` keeps, per account and day with transfers, what was known of the account at the
end of that day. Days are the grain at which a feature store is refreshed; a request sees the last
day before its own, so nothing of its own day leaks into it. The history is built from daily partial
aggregates, so an account has at most one row a day whatever its traffic, and only those rows are
cumulated in one task.

``attach_as_of`` never puts requests and history of an account into one group: the distinct
(account, day) pairs of the requests are resolved against the history first, and requests then meet
their pair in an equi-join on (account, day), so a hot account is cut by day (and a hot day by the
skew join).

Defined results: a null account or a null time has no profile (counts and sums 0, as for an account
without history); a missing amount counts as a transfer but adds nothing; repeated rows count each.
Further columns of the requests are kept; columns of the profile's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.operators import features as FE

ROLES = {"sender": ("sender_account", "receiver_account", "amount_paid"),
         "receiver": ("receiver_account", "sender_account", "amount_received")}


def _daily(df: DataFrame, account: str, other: str, amount: str) -> DataFrame:
    """(account_id, day, n, na, s, mean, m2, fresh): one day's own aggregates; ``fresh`` counts the
    counterparties whose first day with the account this is."""
    rows = df.where(F.col(account).isNotNull() & F.col("ts").isNotNull()).select(
        F.col(account).alias("account_id"), F.to_date("ts").alias("day"), F.col(other).alias("_o"),
        F.when(~F.isnan(F.col(amount).cast("double")), F.col(amount).cast("double")).alias("_x"))
    own = rows.groupBy("account_id", "day").agg(
        F.count(F.lit(1)).alias("n"), F.count("_x").alias("na"), F.sum(F.col("_x").cast(FE.MONEY_DEC)).alias("s"),
        F.avg("_x").alias("mean"), (F.var_pop("_x") * F.count("_x")).alias("m2"))
    # first meetings: pairs first, so that a hot account's counterparties spread over many tasks
    fresh = (rows.where(F.col("_o").isNotNull()).groupBy("account_id", "_o").agg(F.min("day").alias("day"))
             .groupBy("account_id", "day").agg(F.count(F.lit(1)).alias("fresh")))
    return own.join(fresh, ["account_id", "day"], "left").fillna(0, ["fresh"])


def profile_history(df: DataFrame, role: str) -> DataFrame:
    """(account_id, day, tx_count, total_amount, mean_amount, std_amount, diversity): all transfers of
    the account up to and including ``day``.

    Squared deviations are merged about the account's first daily mean, so large amounts that differ
    little keep their spread."""
    daily = _daily(df, *ROLES[role])
    up_to = Window.partitionBy("account_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("_p", F.first("mean", ignorenulls=True).over(up_to))
    off = F.coalesce(F.col("mean") - F.col("_p"), F.lit(0.0))
    d = d.select(
        "account_id", "day", F.sum("n").over(up_to).alias("n"), F.sum("na").over(up_to).alias("na"),
        F.sum("s").over(up_to).cast("double").alias("s"), F.sum("fresh").over(up_to).alias("diversity"),
        F.sum(F.coalesce("m2", F.lit(0.0)) + F.col("na") * off * off).over(up_to).alias("_q"),
        F.sum(F.col("na") * off).over(up_to).alias("_d"))
    m2 = F.greatest(F.col("_q") - F.try_divide(F.col("_d") * F.col("_d"), F.col("na").cast("double")), F.lit(0.0))
    total = F.coalesce(F.col("s"), F.lit(0.0))
    return d.select(
        "account_id", "day", F.col("n").alias("tx_count"), C.fixed(total, 4).alias("total_amount"),
        C.fixed(total / F.col("n"), 6).alias("mean_amount"),
        C.fixed(F.when(F.col("na") > 1, F.sqrt(m2 / (F.col("na") - 1))).otherwise(F.lit(0.0)), 4).alias("std_amount"),
        "diversity")


STATE = ["tx_count", "total_amount", "mean_amount", "std_amount", "diversity"]


def resolve_as_of(pairs: DataFrame, history: DataFrame) -> DataFrame:
    """``pairs`` (account_id, day), distinct: each with the latest state before its day and that state's
    day ``profile_day``. Both sides are one row an account and day; they are merged in one ordered pass."""
    state = F.struct(F.col("day").alias("profile_day"), *STATE)
    events = (history.select("account_id", "day", state.alias("_s"), F.lit(False).alias("_asked"))
              .unionByName(pairs.select("account_id", "day", F.lit(None).cast(_type_of(history)).alias("_s"),
                                        F.lit(True).alias("_asked"))))
    days = events.groupBy("account_id", "day").agg(F.max("_s").alias("_s"), F.bool_or("_asked").alias("_asked"))
    before = Window.partitionBy("account_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return (days.withColumn("_s", F.last("_s", ignorenulls=True).over(before)).where("_asked")
            .select("account_id", "day", "_s.*"))


def _type_of(history: DataFrame):
    return history.select(F.struct(F.col("day").alias("profile_day"), *STATE).alias("_s")).schema["_s"].dataType


def attach_as_of(requests: DataFrame, history: DataFrame, role: str) -> DataFrame:
    """``requests`` with the model's profile columns of ``role`` and ``{role}_profile_age`` (days since
    the profile used; null without one)."""
    account = ROLES[role][0]
    other = "receiver" if role == "sender" else "sender"
    names = {"diversity": f"{role}_{other}_diversity", **{c: f"{role}_{c}" for c in STATE if c != "diversity"}}
    if role == "receiver":
        names.pop("std_amount")              # the model has no such feature
    keyed = requests.withColumn("_day", F.to_date("ts"))
    pairs = (keyed.where(F.col(account).isNotNull() & F.col("_day").isNotNull())
             .select(F.col(account).alias("account_id"), F.col("_day").alias("day")).distinct())
    found = resolve_as_of(pairs, history)
    found = found.select(F.col("account_id").alias("_a"), F.col("day").alias("_d"), F.col("profile_day").alias("_pd"),
                         *[F.col(c).alias(f"_v_{c}") for c in names])
    j = keyed.join(found, (F.col(account) == F.col("_a")) & (F.col("_day") == F.col("_d")), "left")
    for c, out in names.items():
        zero = F.lit(0).cast(found.schema[f"_v_{c}"].dataType)
        j = j.withColumn(out, F.coalesce(F.col(f"_v_{c}"), zero))
    return (j.withColumn(f"{role}_profile_age", F.datediff("_day", "_pd"))
            .drop("_day", "_a", "_d", "_pd", *[f"_v_{c}" for c in names]))


def serving_features(requests: DataFrame, sender_history: DataFrame, receiver_history: DataFrame) -> DataFrame:
    """Both sides' profiles as of each request."""
    return attach_as_of(attach_as_of(requests, sender_history, "sender"), receiver_history, "receiver")
