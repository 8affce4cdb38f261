import os

from pyspark.sql import functions as F

from ledgerlens.operators import graph as GR  # noqa: E402
from ledgerlens.operators import features as FE
from ledgerlens.operators.lookup import lookup
from ledgerlens.plans import training as TR
from ledgerlens.sources import sinks as SK


def test_lookup_keeps_rows_and_fills_default(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "k string")
    table = spark.createDataFrame([("a", 1), ("b", 2)], "value string, code int")
    got = {r.k: r.c for r in lookup(df, "k", table, "value", "code", "c", -1).collect()}
    assert got == {"a": 1, "b": 2, "z": -1, None: -1}


def test_codes_and_profiles_of_the_bundle_are_applied(spark, tx_frame, tmp_path):
    t = tx_frame(n=400, force_pos=8)
    res = TR.run_training(spark, t, out_dir=str(tmp_path / "run"), rounds=2)
    b = SK.load_model_bundle(spark, str(tmp_path / "run" / "bundle"))
    assert set(b["tables"]) == {"dictionaries", "sender_profile", "receiver_profile", "node_scaler"}
    one = t.where("tx_id = 'T000003'").withColumn("payment_currency", F.lit("XAU"))
    f = FE.engineer_features(one, dictionaries=b["tables"]["dictionaries"],
                             profiles=(b["tables"]["sender_profile"], b["tables"]["receiver_profile"])).first()
    whole = FE.engineer_features(t).where("tx_id = 'T000003'").first()
    assert f["payment_currency_enc"] == -1 and f["receiving_currency_enc"] == whole["receiving_currency_enc"]
    # profiles are fitted on the training part: no test transaction is counted
    train = FE.stratified_split(t.select("tx_id", "label"), 0.2, 42).where("is_test = 0").join(t.drop("label"), "tx_id")
    assert f["sender_tx_count"] == train.where(F.col("sender_account") == whole["sender_account"]).count()
    assert whole["sender_tx_count"] == 40
    s = TR.score_batch(t, b["models"]["tabular"], b["models"]["graph"], explain_k=0, tables=b["tables"])
    live = TR.score_batch(t, res["models"]["tabular"], res["models"]["graph"], explain_k=0, tables=res["tables"])
    a = {r.tx_id: r.fused_score for r in s.collect()}
    assert a == {r.tx_id: r.fused_score for r in live.collect()} and len(a) == 400


def test_small_amounts_are_summed_exactly(spark):
    t = spark.range(1000).select(F.lit("A").alias("sender_account"), F.lit("B").alias("receiver_account"),
                                 F.lit(0.000214).alias("amount_paid"), F.lit(0.000214).alias("amount_received"))
    assert FE.sender_profile(t).first()["sender_total_amount"] == 0.214
    assert FE.receiver_profile(t).first()["receiver_total_amount"] == 0.214


def test_write_features_partitioned_by_month(spark, tx_frame, tmp_path):
    f = FE.engineer_features(tx_frame(n=800))
    SK.write_features(f, str(tmp_path / "feat"))
    back = spark.read.parquet(str(tmp_path / "feat"))
    assert back.count() == 800
    parts = sorted(d for d in os.listdir(tmp_path / "feat") if d.startswith("event_month="))
    assert parts == ["event_month=2024-01-01", "event_month=2024-02-01"]


def test_alerts_metrics_and_bundle(spark, tx_frame, tmp_path):
    t = tx_frame(n=400, force_pos=8)
    scored = t.withColumn("fused_score", F.lit(0.9)).withColumn("is_fraud", F.lit(True))
    rec = SK.alert_records(scored, ["tx_id", "sender_account", "amount_paid"])
    SK.write_alerts(rec, str(tmp_path / "alerts"))
    a = spark.read.json(str(tmp_path / "alerts"))
    assert a.count() == 400 and "transaction" in a.columns and "alerted_at" in a.columns
    run = SK.append_run_metrics(spark, str(tmp_path / "runs"), "unit", {"pr_auc": 0.5}, {"rounds": 3})
    m = spark.read.parquet(str(tmp_path / "runs")).where(F.col("run_id") == run)
    assert {r.key: r.value for r in m.collect()} == {"pr_auc": 0.5, "param.rounds": 3.0}
    assert SK.load_model_bundle(spark, str(tmp_path / "missing")) is None


def test_training_bundle_and_retrain_on_drift(spark, tx_frame, tmp_path):
    t = tx_frame(n=600, force_pos=12)
    res = TR.run_training(spark, t, out_dir=str(tmp_path / "run"), rounds=3, with_graph=False)
    assert set(res["models"]) == {"tabular"}
    summary = res["summary"].first()
    assert summary["train_size"] + summary["test_size"] == 600
    b = SK.load_model_bundle(spark, str(tmp_path / "run" / "bundle"))
    assert b is not None and "tabular" in b["models"]
    f = FE.engineer_features(t)
    shifted = f.withColumn("log_amount_paid", F.col("log_amount_paid") + 5).withColumn("hour", F.col("hour") + 30) \
        .withColumn("log_amount_received", F.col("log_amount_received") * 3) \
        .withColumn("day_of_month", F.col("day_of_month") + 40)   # 4 of 21 drift: 0.19 >= 0.15
    assert TR.retrain_if_drifted(spark, f, f, t, rounds=3, with_graph=False) is None
    r2 = TR.retrain_if_drifted(spark, f, shifted, t, out_dir=str(tmp_path / "run2"), rounds=3, with_graph=False)
    assert r2 is not None and r2["drift"]["retrain"]


def test_edges_are_scored_without_wide_rows(spark, tx_frame, tmp_path):
    """An edge moves two numbers instead of two embeddings, and its score is the model's own."""
    from ledgerlens.operators import models as ML
    t = tx_frame(n=300, force_pos=12)
    light = TR.graph_rows(t)
    emb = TR.graph_embedding(light)
    known = emb.where("account_id <> 'ACC_003'")                  # an account without an embedding
    rep, cols = TR.graph_edge_table(light, emb=known)
    model = ML.fit_graph(rep, cols, max_iter=5)
    got = ML.score_edges(model, GR.edge_features(light), known, cols, "p")
    want = ML.score(model, rep, "q").select("tx_id", "q")
    j = got.join(want, "tx_id")
    assert j.count() == 300 and j.where(F.abs(F.col("p") - F.col("q")) > 1e-9).count() == 0
