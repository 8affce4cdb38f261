"""Transaction sources (SRC-1..7): typed load, label, summary, normalisation, validation.

The canonical transaction table has one row per transfer:

    tx_id, ts, from_bank, sender_account, to_bank, receiver_account, amount_received,
    receiving_currency, amount_paid, payment_currency, payment_format, label
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import columns as C
from ledgerlens.session import configure, cut_lineage

# Raw bank-export layout, given by position (the export repeats the header "Account").
RAW_COLUMNS = [
    ("ts_raw", "Timestamp"),
    ("from_bank", "From Bank"),
    ("sender_account", "Account"),
    ("to_bank", "To Bank"),
    ("receiver_account", "Account.1"),
    ("amount_received_raw", "Amount Received"),
    ("receiving_currency", "Receiving Currency"),
    ("amount_paid_raw", "Amount Paid"),
    ("payment_currency", "Payment Currency"),
    ("payment_format", "Payment Format"),
    ("label_raw", "Is Laundering"),
]
RAW_SCHEMA = T.StructType([T.StructField(n, T.StringType(), True) for n, _ in RAW_COLUMNS])

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("tx_id", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("from_bank", T.StringType(), True),
    T.StructField("sender_account", T.StringType(), True),
    T.StructField("to_bank", T.StringType(), True),
    T.StructField("receiver_account", T.StringType(), True),
    T.StructField("amount_received", T.DoubleType(), True),
    T.StructField("receiving_currency", T.StringType(), True),
    T.StructField("amount_paid", T.DoubleType(), True),
    T.StructField("payment_currency", T.StringType(), True),
    T.StructField("payment_format", T.StringType(), True),
    T.StructField("label", T.IntegerType(), True),
])
TX_COLUMNS = [f.name for f in TRANSACTION_SCHEMA.fields]


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv", time_kind: str = "timestamp",
                      strict_label: bool = True) -> DataFrame:
    """SRC-1/2/6: typed scan of a raw bank export (CSV with header, or Parquet with the same
    11 columns in order). Columns are taken by position, never inferred; ids stay strings."""
    configure(spark)
    if fmt == "csv":
        raw = spark.read.schema(RAW_SCHEMA).option("header", "true").option("mode", "PERMISSIVE").csv(path)
    else:
        src = spark.read.format(fmt).load(path)
        raw = src.select([F.col(f"`{c}`").cast("string").alias(n) for c, (n, _) in zip(src.columns, RAW_COLUMNS)])
    for c in ("from_bank", "sender_account", "to_bank", "receiver_account", "receiving_currency",
              "payment_currency", "payment_format"):
        raw = raw.withColumn(c, F.trim(F.col(c)))
    ts = parse_event_time(F.col("ts_raw"), time_kind)
    df = raw.select(
        F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(n), F.lit("")) for n, _ in RAW_COLUMNS]), 256)
        .alias("tx_id"),
        ts.alias("ts"),
        "from_bank", "sender_account", "to_bank", "receiver_account",
        C.coerce_amount("amount_received_raw", from_string=True).alias("amount_received"),
        "receiving_currency",
        C.coerce_amount("amount_paid_raw", from_string=True).alias("amount_paid"),
        "payment_currency", "payment_format",
        F.col("label_raw").alias("label"),
    )
    return resolve_label(number_equal_rows(df), strict=strict_label)


def number_equal_rows(df: DataFrame, key: str = "tx_id") -> DataFrame:
    """Make ``key``, a digest of the row, unique: the k-th of equal rows (k > 1) gets ``-k`` behind it.

    Most rows are alone with their digest and are not moved: an 8-byte hash of the key is counted, and only
    rows whose hash comes again are numbered (two keys of one hash cost a few more rows, no wrong number).
    These are numbered within their input partition and shifted by the counts of the partitions
    before, so a row that is repeated very often is spread over as many tasks as it has partitions.
    Equal rows may change places when a task is run again, which changes no row."""
    hashed = df.withColumn("_h", F.xxhash64(key))
    # a written table: the planner knows its size before it decides whether rows are moved for it
    again = cut_lineage(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_h"))
    single = hashed.join(again, "_h", "left_anti").select(*df.columns)
    part = hashed.join(again, "_h", "left_semi").withColumn("_part", F.spark_partition_id())
    local = part.withColumn("_k", F.row_number().over(Window.partitionBy(key, "_part").orderBy(key)))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (part.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
             .select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    k = F.col("_before") + F.col("_k")
    numbered = (local.join(shift, [key, "_part"])
                .withColumn(key, F.when(k > 1, F.concat(key, F.lit("-"), k.cast("string"))).otherwise(F.col(key)))
                .select(*df.columns))
    return single.unionByName(numbered)


def resolve_label(df: DataFrame, strict: bool = True) -> DataFrame:
    """SRC-2: integer 0/1 label from ``label`` / ``Is Laundering`` / ``is_laundering``.
    Strict mode raises when none is present; lenient mode fills 0."""
    for name in ("label", "Is Laundering", "is_laundering"):
        if name in df.columns:
            lab = F.trim(F.col(f"`{name}`").cast("string")).try_cast("double").cast("int")
            out = df.withColumn("label", lab)
            return out.drop(name) if name != "label" else out
    if strict:
        raise ValueError(f"label column not found; columns: {df.columns}")
    return df.withColumn("label", F.lit(0))


# Timestamp layouts tried, in order, when no format is given (ISO first, then the bank export's).
TIME_FORMATS = ["yyyy/MM/dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd"]


def parse_event_time(c: Column, kind: str = "timestamp", fmt: str | None = None) -> Column:
    """SRC-6: event time from text. ``timestamp`` parses with ``fmt``, or else ISO and then the
    layouts in ``TIME_FORMATS``; ``day_number`` treats the value as whole days since
    1970-01-01 (hour 0). Unparsable text gives NULL (no exception path)."""
    if kind == "timestamp":
        if fmt:
            return F.try_to_timestamp(c, F.lit(fmt))
        return F.coalesce(F.try_to_timestamp(c), *[F.try_to_timestamp(c, F.lit(f)) for f in TIME_FORMATS])
    if kind == "day_number":
        days = c.cast("string").try_cast("double").cast("long")
        return F.timestamp_seconds(days * F.lit(86400))
    raise ValueError(f"unknown time kind {kind!r}")


def transactions_from_tables(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The canonical transaction table over the driver's star schema.

    lineitem ⨝ orders (sender = customer, event time = order date) and ⨝ supplier
    (receiver). Bank = region of the nation, currency = nation name. Nation is a fixed
    25-row table and is broadcast; customer / supplier / orders are left to AQE, which
    broadcasts only what its measured shuffle size allows and sort-merges the rest.
    Lines, the longest table, are moved once, to their orders, which have met their customers before; they
    travel as numbers, and texts (ids, nations, banks) are made behind the last join.
    ``extra`` carries further lineitem / orders columns through unchanged.
    """
    configure(spark)
    lines, orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    received = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    li = lines.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("_quantity"),
        received.alias("amount_received"), (received * (F.lit(1.0) + F.col("l_tax"))).alias("amount_paid"),
        F.col("l_shipdate").cast("date").alias("_shipped"),
        ((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49) & (F.col("l_discount") >= 0.08))
        .cast("int").alias("label"),
        *[c for c in extra if c in lines.columns])
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", *[c for c in extra if c in orders.columns])
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    supp = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")

    def of_nation(key: str, side: str) -> DataFrame:
        return F.broadcast(nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(f"{side}_currency"),
                                         F.col("n_regionkey").cast("string").alias(f"{side}_bank")))

    placed = o.join(cust, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    j = (li.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
         .join(of_nation("c_nationkey", "c"), "c_nationkey").join(of_nation("s_nationkey", "s"), "s_nationkey"))
    return j.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    F.col("_quantity").cast("string"), F.date_format("_shipped", "yyyyMMdd")).alias("tx_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("c_bank").alias("from_bank"),
        F.concat(F.lit("ACC_"), F.col("o_custkey").cast("string")).alias("sender_account"),
        F.col("s_bank").alias("to_bank"),
        F.concat(F.lit("ACC_"), F.col("l_suppkey").cast("string")).alias("receiver_account"),
        "amount_received",
        F.col("s_currency").alias("receiving_currency"),
        "amount_paid",
        F.col("c_currency").alias("payment_currency"),
        F.col("o_orderpriority").alias("payment_format"),
        "label",
        *[F.col(c) for c in extra],
    )


def events_as_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microsecond-stamped event feed mapped onto the transaction layout (stream and
    point-in-time operators): user = sender, event type = payment format, value = amount."""
    configure(spark)
    return events_to_transactions(spark.read.parquet(f"{sf_dir}/events.parquet"))


def events_to_transactions(ev: DataFrame) -> DataFrame:
    """The event layout (event_id, ts, user_id, event_type, value) as transactions; works on
    static and streaming frames alike."""
    return ev.select(
        F.col("event_id").cast("string").alias("tx_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("0").alias("from_bank"),
        F.concat(F.lit("USR_"), F.col("user_id").cast("string")).alias("sender_account"),
        F.lit("0").alias("to_bank"),
        F.concat(F.lit("EVT_"), F.col("event_type")).alias("receiver_account"),
        F.col("value").alias("amount_received"),
        F.lit("USD").alias("receiving_currency"),
        F.col("value").alias("amount_paid"),
        F.lit("USD").alias("payment_currency"),
        F.col("event_type").alias("payment_format"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


def label_summary(df: DataFrame) -> DataFrame:
    """SRC-3: rows, positives and positive rate (percent, 6 dp)."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).cast("long").alias("n_positive"),
        C.fixed(F.try_divide(F.sum(F.col("label").cast("double")) * 100.0, F.count(F.lit(1))), 6)
        .alias("positive_rate_pct"),
    )


# Fixed defaults of the scoring request (values must equal the reference's).
DEFAULT_CURRENCY = "USD"
DEFAULT_FORMAT = "Wire Transfer"
DEFAULT_BANK = ""
DEFAULT_AMOUNT = 1.0


def _text_or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(default))


def normalize_transactions(df: DataFrame) -> DataFrame:
    """SRC-4: canonical scoring request per row — empty text takes the request default,
    zero / missing amounts become 1.0; event time is kept (not replaced by wall clock)."""
    return df.select(
        "tx_id", "ts",
        _text_or(F.col("sender_account"), "").alias("sender_account"),
        _text_or(F.col("receiver_account"), "").alias("receiver_account"),
        F.coalesce(F.nullif(F.col("amount_paid"), F.lit(0.0)), F.lit(DEFAULT_AMOUNT)).alias("amount_paid"),
        F.coalesce(F.nullif(F.col("amount_received"), F.lit(0.0)), F.lit(DEFAULT_AMOUNT)).alias("amount_received"),
        _text_or(F.col("payment_currency"), DEFAULT_CURRENCY).alias("payment_currency"),
        _text_or(F.col("receiving_currency"), DEFAULT_CURRENCY).alias("receiving_currency"),
        _text_or(F.col("payment_format"), DEFAULT_FORMAT).alias("payment_format"),
        _text_or(F.col("from_bank"), DEFAULT_BANK).alias("from_bank"),
        _text_or(F.col("to_bank"), DEFAULT_BANK).alias("to_bank"),
        "label",
    )


def rejection_reasons(df: DataFrame) -> Column:
    """Array of rule names a request breaks (empty array = valid)."""
    rules = [
        ("missing_sender", F.coalesce(F.trim(F.col("sender_account")), F.lit("")) == ""),
        ("missing_receiver", F.coalesce(F.trim(F.col("receiver_account")), F.lit("")) == ""),
        ("amount_paid_not_positive", ~F.coalesce(F.col("amount_paid") > 0, F.lit(False))),
        ("amount_received_not_positive", ~F.coalesce(F.col("amount_received") > 0, F.lit(False))),
        ("missing_timestamp", F.col("ts").isNull()),
    ]
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]), lambda x: x.isNotNull())


def validate_transactions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-5: split into (valid, rejected); rejected rows carry ``reasons``."""
    tagged = df.withColumn("reasons", rejection_reasons(df))
    valid = tagged.filter(F.size("reasons") == 0).drop("reasons")
    rejected = tagged.filter(F.size("reasons") > 0)
    return valid, rejected


def read_limit(df: DataFrame, n: int) -> DataFrame:
    """SRC-7: the first ``n`` transactions in event order (explicit order: ts, tx_id)."""
    return df.orderBy(F.col("ts").asc_nulls_last(), F.col("tx_id")).limit(n)
