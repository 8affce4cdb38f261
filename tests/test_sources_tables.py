from pyspark.sql import functions as F

from ledgerlens.sources import transactions as SRC

SF = "/root/testdata/sf0.001"


def test_transactions_from_tables_keeps_every_line(spark):
    t = SRC.transactions_from_tables(spark, SF)
    n_lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    r = t.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tx_id").alias("ids"),
              F.sum("label").alias("pos"), F.count_if(F.col("ts").isNull()).alias("no_ts")).first()
    assert r.n == n_lines and r.ids == n_lines and r.no_ts == 0
    assert r.pos == 22          # SURVEY §7.2: 22 positives at sf0.001
    assert dict(t.dtypes)["ts"] == "timestamp"


def test_events_as_transactions(spark):
    e = SRC.events_as_transactions(spark, SF)
    assert e.count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert e.where(F.col("sender_account").startswith("USR_")).count() == e.count()


def test_lines_travel_once_and_without_texts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")      # as on tables too large to broadcast
    try:
        plan = SRC.transactions_from_tables(spark, SF)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [plan[i + 1] for i, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    assert moved and not [line for line in moved if "n_name" in line or "_currency" in line]
