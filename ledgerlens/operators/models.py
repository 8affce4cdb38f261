"""Classifiers, scoring and feature contributions (ML-1..4, ML-7..10).

* tabular model: class-weighted second-order boosted trees (``boosting``);
* graph model: class-weighted logistic regression on the edge representation (GR-12) —
  a linear head on pre-computed propagation, not a trained neighbour network;
* contributions: for the linear head coef x standardised value (column expressions); for the
  trees path-dependent Shapley values (``boosting``).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.operators import boosting as BO

SEED = 42


def positive_weight(df: DataFrame, label: str = "label") -> float:
    """AGG-7 as a number: n_neg / max(n_pos, 1) (one bounded row)."""
    r = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    return float(r["n"]) / float(max(r["p"], 1))


def with_class_weight(df: DataFrame, w: float, label: str = "label", out: str = "weight") -> DataFrame:
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(w))).otherwise(F.lit(1.0)))


def fit_tabular(train: DataFrame, cols: list[str], label: str = "label", rounds: int = BO.ROUNDS,
                max_depth: int = BO.MAX_DEPTH, step: float = BO.STEP, seed: int = SEED) -> BO.BoostedTrees:
    """ML-1: boosted trees, positive class weighted by n_neg / n_pos."""
    return BO.fit(train, cols, positive_weight(train, label), label, rounds, max_depth, step, seed)


def fit_graph(train: DataFrame, cols: list[str], label: str = "label", max_iter: int = 100) -> PipelineModel:
    """ML-3: class-weighted logistic regression on standardised edge representations."""
    w = positive_weight(train, label)
    data = with_class_weight(train.select(*cols, label), w, label)
    asm = VectorAssembler(inputCols=cols, outputCol="raw_features", handleInvalid="keep")
    sc = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", maxIter=max_iter,
                            regParam=1e-4)
    return Pipeline(stages=[asm, sc, lr]).fit(data.withColumn(label, F.col(label).cast("double")))


def score(model, df: DataFrame, out: str) -> DataFrame:
    """ML-2 / ML-4: positive-class probability as column ``out`` (input columns kept)."""
    if isinstance(model, BO.BoostedTrees):
        return BO.score(model, df, out)
    keep = df.columns
    s = model.transform(df)
    return s.select(*keep, vector_to_array("probability")[1].alias(out))


def node_margins(model: PipelineModel, emb: DataFrame, cols: list[str], node: str = "account_id") -> tuple[DataFrame, dict[str, float]]:
    """The graph head's sum over an account's embedding, once as a source and once as a destination: (node,
    margin_src, margin_dst), and both sums of an account without an embedding (0 in every column). The head is
    linear, so an edge moves two numbers instead of two embeddings."""
    weight = _weights(model, cols)
    sums, none = [], {}
    for side in ("src", "dst"):
        mine = {c: weight[f"{side}_{c}"] for c in emb.columns if c != node}
        none[side] = sum(-k * m for k, m in mine.values())
        sums.append(sum((F.lit(k) * (F.col(c) - F.lit(m)) for c, (k, m) in mine.items()), F.lit(0.0)).alias(f"margin_{side}"))
    return emb.select(node, *sums), none


def _weights(model: PipelineModel, cols: list[str]) -> dict[str, tuple[float, float]]:
    """(coefficient of x - mean, mean) of every column."""
    sc, lr = model.stages[1], model.stages[2]
    return {c: (float(k) / float(s) if s != 0 else 0.0, float(m))
            for c, k, s, m in zip(cols, lr.coefficients.toArray(), sc.std.toArray(), sc.mean.toArray())}


def score_edges(model: PipelineModel, edge_feats: DataFrame, emb: DataFrame, cols: list[str], out: str,
                node: str = "account_id") -> DataFrame:
    """ML-4 from embeddings: what ``score`` gives on the edge representation of ``edge_feats`` and ``emb``, from
    the accounts' margins; (tx_id, out)."""
    from ledgerlens.operators.graph import edge_representation
    margins, none = node_margins(model, emb, cols, node)
    weight = _weights(model, cols)
    rep = edge_representation(edge_feats, margins, node)
    own = [c for c in cols if c in edge_feats.columns]
    total = F.lit(float(model.stages[2].intercept))
    for c in own:
        total = total + F.lit(weight[c][0]) * (F.col(c) - F.lit(weight[c][1]))
    for side in ("src", "dst"):
        total = total + F.coalesce(F.col(f"{side}_margin_{side}"), F.lit(none[side]))
    return rep.select("tx_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-total))).alias(out))


# --- contributions (ML-7..9) -----------------------------------------------------------------------

def linear_contributions(model: PipelineModel, df: DataFrame, cols: list[str], out: str = "contributions") -> DataFrame:
    """ML-7a: coef_i * (x_i - mean_i) / std_i per feature; intercept + sum = margin."""
    sc, lr = model.stages[1], model.stages[2]
    mean, std, coef = sc.mean.toArray(), sc.std.toArray(), lr.coefficients.toArray()
    items = []
    for i, c in enumerate(cols):
        s = float(std[i]) if std[i] != 0 else 1.0
        z = (F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) - F.lit(float(mean[i]))) / F.lit(s)
        items.append(F.struct(F.lit(c).alias("feature"), (F.lit(float(coef[i])) * z).alias("contribution")))
    return df.withColumn(out, F.array(*items)).withColumn("base_margin", F.lit(float(lr.intercept)))


def tree_contributions(model: BO.BoostedTrees, df: DataFrame, cols: list[str], key: str = "tx_id",
                       out: str = "contributions") -> DataFrame:
    """ML-7b: per row (key, base_margin, margin, contributions array<struct<feature, contribution>>)."""
    if list(cols) != model.features:
        raise ValueError("the model was fitted on other features")
    return BO.row_contributions(model, df, key, out)


def risk_factors(df: DataFrame, contrib: str = "contributions", k: int = 5) -> DataFrame:
    """ML-8: the top-k factors per row (see ``fusion.top_k_factors``)."""
    from ledgerlens.operators.fusion import top_k_factors
    return df.withColumn("top_risk_factors", top_k_factors(contrib, k))


def global_importance(df: DataFrame, contrib: str = "contributions") -> DataFrame:
    """ML-9: mean |contribution| per feature over all rows."""
    e = df.select(F.explode(contrib).alias("c"))
    return e.groupBy(F.col("c.feature").alias("feature")).agg(
        C.fixed(F.avg(F.abs("c.contribution")), 6).alias("mean_abs_contribution"))
