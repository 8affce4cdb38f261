"""A written table replaces what was shuffled for it."""

import time

from pyspark.sql import functions as F

from ledgerlens.session import SHUFFLE_CLEANUP, cut_lineage


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_go_when_the_table_is_written(spark):
    set_before, before = spark.conf.get(SHUFFLE_CLEANUP, None), shuffle_files(spark)
    df = spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.sum("id").alias("s"))
    out = cut_lineage(df)
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == set_before
    assert out.count() == 5000 and df.count() == 5000       # the frame itself can still be run


def test_features_join_written_profiles(spark, tx_frame):
    from ledgerlens.operators import features as FE
    tx = tx_frame(n=200, pos_rate=0.1)
    plan = FE.engineer_features(tx).select("tx_id", *FE.FEATURE_COLUMNS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan      # nothing of the profiles is shuffled beside the rows
    assert FE.engineer_features(tx).count() == 200
