"""Composed jobs: training run (§3.1), batch scoring (ML-10), drift-triggered retraining (DR-6).

Cut points are written tables in the shared checkpoint folder (features, scored rows), so a
lost executor never replays the whole lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.operators import boosting as BO
from ledgerlens.operators import drift as DR
from ledgerlens.operators import features as FE
from ledgerlens.operators import fusion as FU
from ledgerlens.operators import graph as GR
from ledgerlens.operators import metrics as EV
from ledgerlens.operators import models as ML
from ledgerlens.session import cut_lineage, scratch_path, written
from ledgerlens.sources import sinks as SK

EDGE_FEATURES = ["e_log_amount", "e_cross_currency", "e_format", "e_cross_bank"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (a lineage cut that
    survives executor loss and is reusable by several actions)."""
    return written(df, scratch_path(df.sparkSession, name))


NEED = ["tx_id", "ts", "sender_account", "receiver_account", "amount_paid", "amount_received", "label",
        "is_cross_currency", "payment_format_enc", "is_cross_bank"]


def graph_rows(tx: DataFrame, dictionaries: DataFrame | None = None, *keep: str) -> DataFrame:
    """What the graph needs of every transaction; no account profiles, so nothing is moved for it."""
    return FE.encode_categories(FE.cross_flags(FE.amount_features(tx)), dictionaries).select(*NEED, *keep)


def graph_embedding(base: DataFrame, hops: int = 2, scaler: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """GR-3 + GR-11: (x, Ax, A²x) of the 8 node features, standardised by the fitted ``scaler``, of the graph of
    ``base``. ``nodes``: its node features, where they are known."""
    nf = GR.node_features(base, dp=None) if nodes is None else nodes
    nf = GR.standardize(nf, GR.NODE_FEATURES, suffix="", scaler=scaler)
    return GR.khop_embedding(GR.multi_edges(base), nf, GR.NODE_FEATURES, k=hops)


def graph_columns(emb: DataFrame, node: str = "account_id") -> list[str]:
    """Columns of the edge representation that the graph model is fitted on, in order."""
    return EDGE_FEATURES + [f"{side}_{c}" for side in ("src", "dst") for c in emb.columns if c != node]


def graph_edge_table(feats: DataFrame, hops: int = 2, scaler: DataFrame | None = None,
                     graph_of: DataFrame | None = None, emb: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """GR-3 + GR-11 + GR-12: per transaction, source and destination embeddings (x, Ax, A²x of
    the 8 node features, standardised by the fitted ``scaler``) and the 4 edge features.

    ``graph_of``: the transactions that make the graph, by default ``feats``; an account that is not in
    it has the mean (0) in every embedding column. ``emb``: the graph's embeddings, where they are known."""
    if emb is None:
        emb = graph_embedding((feats if graph_of is None else graph_of).select(*NEED), hops, scaler)
    rep = GR.edge_representation(GR.edge_features(feats.select(*NEED)), emb)
    cols = graph_columns(emb)
    return rep.fillna(0.0, [c for c in cols if c not in EDGE_FEATURES]), cols


def run_training(spark: SparkSession, tx: DataFrame, out_dir: str | None = None, rounds: int = BO.ROUNDS,
                 test_frac: float = 0.2, seed: int = 42, tabular_weight: float = FU.DEFAULT_TABULAR_WEIGHT,
                 threshold: float = FU.DEFAULT_THRESHOLD, with_graph: bool = True) -> dict:
    """Train both models on the same stratified split, fuse on the transaction key (JOIN-7),
    evaluate tabular / graph / fused (EVAL-7/8), and record a one-row summary (EVAL-9). Dictionaries,
    profiles, scaler and the graph come from the training part only, so no test row is in them."""
    split = FE.stratified_split(tx.select("tx_id", "label"), test_frac, seed).groupBy("tx_id").agg(
        F.count_if(F.col("is_test") == 0).cast("int").alias("_train"), F.count_if(F.col("is_test") == 1).cast("int").alias("_test"))
    rows = materialize(tx.join(split, "tx_id"), "transactions-split")
    fitted = rows.where("_train > 0").drop("_train", "_test")
    # a repeated tx_id meets each row of the split that bears it, as an edge twice
    parts = F.concat(F.array_repeat(F.lit(0), F.col("_train")), F.array_repeat(F.lit(1), F.col("_test")))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("is_test") == 0, F.col("_train")).otherwise(F.col("_test"))))
    ways = rows.withColumn("_way", F.explode(F.array_repeat(F.lit(1), F.col("_train") + F.col("_test"))))
    edge_rows = [ways.withColumn("is_test", F.lit(k)).withColumn("_time", times).drop("_train", "_test", "_way", "_time") for k in (0, 1)]
    rows = rows.withColumn("is_test", F.explode(parts)).drop("_train", "_test")
    dictionaries, profiles = FE.fit_dictionaries(fitted), FE.fit_profiles(fitted)
    tables = {"dictionaries": dictionaries, "sender_profile": profiles[0], "receiver_profile": profiles[1]}
    cols = FE.FEATURE_COLUMNS
    data = materialize(FE.engineer_features(rows, dictionaries=dictionaries, profiles=profiles)
                       .select("tx_id", "label", "is_test", *cols), "features-split")
    train, test = data.where(F.col("is_test") == 0), data.where(F.col("is_test") == 1)
    tab = ML.fit_tabular(train, cols, rounds=rounds, seed=seed)
    scored = ML.score(tab, test.select("tx_id", "label", *cols), "tabular_score")
    models = {"tabular": tab}
    if with_graph:
        graph_of = graph_rows(rows.where("is_test = 0"), dictionaries)
        fit_rows, held_out = (graph_rows(r, dictionaries) for r in edge_rows)
        nodes = materialize(GR.node_features(graph_of, dp=None), "node-features")
        tables["node_scaler"] = GR.fit_scaler(nodes, GR.NODE_FEATURES)
        emb = materialize(graph_embedding(graph_of, scaler=tables["node_scaler"], nodes=nodes), "embedding")
        rep, gcols = graph_edge_table(fit_rows, emb=emb)
        # the fit reads the wide rows many times; no others are written
        gm = ML.fit_graph(materialize(rep.select("label", *gcols), "edge-repr"), gcols)
        gs = ML.score_edges(gm, GR.edge_features(held_out), emb, gcols, "gnn_score")
        scored = scored.join(gs, "tx_id", "left")
        models["graph"] = gm
    else:
        scored = scored.withColumn("gnn_score", F.lit(None).cast("double"))
    scored = materialize(FU.fuse(scored, tabular_weight=tabular_weight, threshold=threshold), "scored-test")
    cmp = EV.compare_models(scored, {"tabular": "tabular_score", "graph": "gnn_score", "fused": "fused_score"})
    split_rows = data.select("tx_id", "label", "is_test")
    summary = training_summary(split_rows, tabular_weight, threshold)
    result = {"models": models, "scored": scored, "comparison": cmp, "summary": summary, "tables": tables,
              "split": split_rows}
    if out_dir:
        facts = summary.first().asDict()
        metrics = {f"{r['metric']}.{m}": r[m] for r in cmp.collect() for m in ("tabular", "graph", "fused")
                   if r[m] is not None}
        result["run_id"] = SK.append_run_metrics(spark, f"{out_dir}/run_metrics", "training", metrics, facts)
        SK.save_model_bundle(f"{out_dir}/bundle", models, tables, meta={"features": cols, **facts})
    return result


def training_summary(split: DataFrame, tabular_weight: float = FU.DEFAULT_TABULAR_WEIGHT,
                     threshold: float = FU.DEFAULT_THRESHOLD) -> DataFrame:
    """EVAL-9: one row of the split's sizes, the training fraud rate and class weight, and the settings."""
    train = F.col("is_test") == 0
    n, p = F.count_if(train).cast("double"), F.count_if(train & (F.col("label") == 1)).cast("double")
    return split.agg(
        n.alias("train_size"), F.count_if(F.col("is_test") == 1).cast("double").alias("test_size"),
        C.fixed(F.coalesce(F.try_divide(p, n), F.lit(0.0)), 6).alias("fraud_rate_train"),
        C.fixed((n - p) / F.greatest(p, F.lit(1.0)), 6).alias("pos_weight"),
        F.lit(float(tabular_weight)).alias("tabular_weight"), F.lit(float(threshold)).alias("threshold"))


def score_batch(tx: DataFrame, tabular_model, graph_model=None, tabular_weight: float = FU.DEFAULT_TABULAR_WEIGHT,
                threshold: float = FU.DEFAULT_THRESHOLD, explain_k: int = 5,
                tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """ML-10: features -> tabular score (+ graph score when a graph model is given) -> fusion ->
    top contributions. One row per transaction. ``tables``: the training run's dictionaries, account
    profiles and node scaler, as in its result and bundle; without them they are fitted on ``tx``."""
    tables = tables or {}
    profiles = (tables["sender_profile"], tables["receiver_profile"]) if "sender_profile" in tables else None
    dictionaries = tables["dictionaries"] if "dictionaries" in tables else FE.fit_dictionaries(tx)
    feats = FE.engineer_features(tx, dictionaries=dictionaries, profiles=profiles)
    cols = FE.FEATURE_COLUMNS
    s = ML.score(tabular_model, feats.select("tx_id", "ts", "sender_account", "receiver_account", "amount_paid",
                                             "label", *cols), "tabular_score")
    if graph_model is not None:
        light = graph_rows(tx, dictionaries)
        emb = materialize(graph_embedding(light, scaler=tables.get("node_scaler")), "embedding")
        g = ML.score_edges(graph_model, GR.edge_features(light), emb, graph_columns(emb), "gnn_score")
        s = s.join(g, "tx_id", "left")
    else:
        s = s.withColumn("gnn_score", F.lit(None).cast("double"))
    fused = FU.fuse(s, tabular_weight=tabular_weight, threshold=threshold)
    if explain_k:
        contrib = ML.tree_contributions(tabular_model, feats, cols)
        fused = fused.join(ML.risk_factors(contrib, k=explain_k).select("tx_id", "top_risk_factors"), "tx_id", "left")
    return fused


def retrain_if_drifted(spark: SparkSession, ref: DataFrame, cur: DataFrame, train_tx: DataFrame,
                       threshold: float = DR.RETRAIN_SHARE, out_dir: str | None = None, **kw) -> dict | None:
    """DR-5 + DR-6: compute drift of the feature columns; when it warrants it, rerun training
    on ``train_tx``. Failures are raised, not swallowed."""
    fd, dd = DR.drift_report(ref, cur, FE.FEATURE_COLUMNS)
    decision = DR.should_retrain(dd, threshold).first()
    if not decision["retrain"]:
        return None
    result = run_training(spark, train_tx, out_dir=out_dir, **kw)
    if out_dir:
        SK.append_run_metrics(spark, f"{out_dir}/run_metrics", "drift_triggered_retrain",
                              {"drift_score": float(decision["drift_score"])}, run_id=result.get("run_id"))
    result["drift"] = decision.asDict()
    return result


__all__ = ["run_training", "score_batch", "retrain_if_drifted", "training_summary", "graph_edge_table",
           "materialize", "cut_lineage"]
