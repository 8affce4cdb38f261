"""Equal rows keep their own identity; null labels and null groups stay; flags follow the unrounded score."""

from pyspark.sql import functions as F

from ledgerlens.operators import features as FE
from ledgerlens.operators import fusion as FU
from ledgerlens.operators import service as SV
from ledgerlens.sources import transactions as SRC

HEADER = "Timestamp,From Bank,Account,To Bank,Account.1,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"


def test_equal_rows_get_their_own_ids(spark, tmp_path):
    row = "2024-01-0{},1,A{},2,B,{}.5,USD,{}.5,USD,Wire,0"
    lines = [row.format(1, 1, 7, 7)] * 3 + [row.format(2, 2, 8, 8), row.format(3, 3, 9, 9)]
    for k in range(2):          # equal rows in several files
        (tmp_path / f"part{k}.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    df = SRC.read_transactions(spark, str(tmp_path), time_kind="timestamp", fmt="csv")
    ids = [r["tx_id"] for r in df.collect()]
    assert len(ids) == 10 == len(set(ids))
    assert len({i.split("-")[0] for i in ids}) == 3
    split = FE.stratified_split(df)
    assert split.count() == 10
    assert df.select("tx_id").join(split, "tx_id").count() == 10


def test_null_labels_stay_in_the_split(spark):
    df = spark.createDataFrame([(f"t{i}", None if i % 4 == 0 else i % 2) for i in range(40)], "tx_id string, label int")
    out = FE.stratified_split(df).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("is_test").alias("t"))
    assert {(r["label"], r["n"], r["t"]) for r in out.collect()} == {(None, 10, 2), (0, 10, 2), (1, 20, 4)}
    assert FE.random_split(df).count() == 40


def test_null_group_has_a_quantile(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0), (None, 7.0)], "g string, v double")
    got = {r["g"]: r["p99"] for r in SV.exact_quantile(df, "v", 0.99, by=["g"]).collect()}
    assert got == {"a": 2.0, None: 7.0}


def test_flag_follows_the_unrounded_score(spark):
    df = spark.createDataFrame([("x", 0.4999997, None), ("y", 0.5, None), ("z", 0.9, None)],
                               "tx_id string, tabular_score double, gnn_score double")
    fused = FU.fuse(df)
    assert {r["tx_id"] for r in FU.flag(fused).collect()} == {"y", "z"}
    assert {r["tx_id"] for r in FU.flag(fused, threshold=0.8).collect()} == {"z"}


def test_single_rows_are_not_moved_to_be_numbered(spark):
    df = spark.createDataFrame([(k, v) for k, n in (("a", 1), ("b", 3), ("c", 1), ("d", 2)) for v in [k * 2] * n], "tx_id string, v string")
    out = SRC.number_equal_rows(df.repartition(3))
    assert sorted((r.tx_id, r.v) for r in out.collect()) == [("a", "aa"), ("b", "bb"), ("b-2", "bb"), ("b-3", "bb"),
                                                           ("c", "cc"), ("d", "dd"), ("d-2", "dd")]
    single = out._jdf.queryExecution().optimizedPlan().children().apply(0).toString()
    assert "LeftAnti" in single and "Window" not in single
