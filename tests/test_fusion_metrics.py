from datetime import datetime, timedelta


def dt(x):
    return datetime.fromisoformat(x)


import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import fusion as FU
from ledgerlens.operators import metrics as EV
from ledgerlens.operators import service as SV


def _scores(spark, pairs):
    return spark.createDataFrame(pd.DataFrame(pairs, columns=["tabular_score", "gnn_score"]),
                                 "tabular_score double, gnn_score double")


def test_fuse_tabular_only(spark):
    r = FU.fuse(_scores(spark, [(0.8, None)])).first()
    assert r.fused_score == 0.8 and r.is_fraud and (r.weight_tabular, r.weight_graph) == (1.0, 0.0)


def test_fuse_weighted(spark):
    r = FU.fuse(_scores(spark, [(0.4, 0.9)]), tabular_weight=0.6).first()
    assert r.fused_score == pytest.approx(0.6)


def test_threshold_inclusive(spark):
    r = FU.fuse(_scores(spark, [(0.69, None), (0.7, None)]), threshold=0.7).collect()
    assert [x.is_fraud for x in r] == [False, True]


def test_confidence_zero_at_threshold(spark):
    assert FU.fuse(_scores(spark, [(0.5, None)])).first().confidence == 0.0


def test_bad_weight_raises(spark):
    with pytest.raises(ValueError):
        FU.fuse(_scores(spark, [(0.5, None)]), tabular_weight=1.5)


def test_batch_values_in_range(spark):
    r = FU.fuse(_scores(spark, [(0.1, 0.2), (0.5, 0.4), (0.9, 0.8)])).select("fused_score").toPandas()
    assert len(r) == 3 and r.fused_score.between(0, 1).all()


def _lab(spark, y, s):
    return spark.createDataFrame(pd.DataFrame({"label": y, "score": s}), "label int, score double")


def test_perfect_ap(spark):
    assert EV.pr_auc(_lab(spark, [0, 0, 0, 1, 1], [0, .1, .2, .9, 1.0])).first()[0] == 1.0


def test_random_ap_low(spark):
    rng = np.random.default_rng(0)
    y = [0] * 99 + [1]
    assert EV.pr_auc(_lab(spark, y, rng.random(100).tolist())).first()[0] < 0.2


def test_recall_at_fpr_separable(spark):
    assert EV.recall_at_fpr(_lab(spark, [0, 0, 0, 0, 1, 1], [.1, .2, .15, .25, .8, .9])).first()[0] == 1.0


def test_step_ap_not_interpolated(spark):
    assert EV.pr_auc(_lab(spark, [0, 1, 0, 1, 0, 1], [.9, .8, .7, .6, .1, .05])).first()[0] == 0.5


def _brute(y, s):
    y, s = np.asarray(y), np.asarray(s)
    order = np.argsort(-s, kind="mergesort")
    ys, ss = y[order], s[order]
    P, N = ys.sum(), (1 - ys).sum()
    uniq = np.unique(ss)[::-1]
    ap = apt = roc = 0.0
    ptp = pfp = 0
    prev_p = 1.0
    best = 0.0
    for u in uniq:
        tp = int(ys[ss >= u].sum())
        fp = int((ss >= u).sum() - tp)
        prec = tp / (tp + fp)
        ap += (tp - ptp) / P * prec
        apt += (tp - ptp) / P * (prec + prev_p) / 2
        roc += (fp - pfp) * (tp + ptp) / 2
        if fp / N <= 0.05:
            best = max(best, tp / P)
        ptp, pfp, prev_p = tp, fp, prec
    return ap, apt, roc / (P * N), best


@pytest.mark.parametrize("seed", [1, 2])
def test_curve_metrics_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    y = (rng.random(400) < 0.1).astype(int)
    s = np.round(rng.random(400) * 0.5 + y * 0.3, 2)        # many ties
    m = EV.curve_metrics(EV.score_curve(_lab(spark, y.tolist(), s.tolist()), buckets=16)).first()
    ap, apt, roc, rec = _brute(y, s)
    assert m.pr_auc == pytest.approx(ap, abs=1e-6)
    assert m.pr_auc_trapezoid == pytest.approx(apt, abs=1e-6)
    assert m.roc_auc == pytest.approx(roc, abs=1e-6)
    assert m.recall_at_fpr_5pct == pytest.approx(rec, abs=1e-6)


def test_one_class_roc_zero(spark):
    assert EV.roc_auc(_lab(spark, [0, 0, 0], [.1, .2, .3])).first()[0] == 0.0


def test_prf1_zero_division(spark):
    r = EV.precision_recall_f1(_lab(spark, [0, 1], [0.1, 0.2])).first()
    assert (r.precision_at_05, r.recall_at_05, r.f1_at_05) == (0.0, 0.0, 0.0)


def test_exact_p99_matches_index_rule(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.exponential(20, 997), [5.0, 5.0, 5.0]])
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 600 + ["b"] * 400, "v": vals}), "g string, v double")
    got = {r.g: r.p99 for r in SV.exact_quantile(df, "v", 0.99, by=["g"], buckets=8).collect()}
    for g, part in (("a", vals[:600]), ("b", vals[600:])):
        srt = np.sort(part)
        assert got[g] == srt[min(int(0.99 * len(srt)), len(srt) - 1)]
    one = SV.exact_quantile(df, "v", 0.99).first()[0]
    assert one == np.sort(vals)[min(int(0.99 * 1000), 999)]


def test_recent_alerts_limit(spark):
    df = spark.createDataFrame([(f"t{i}", dt("2024-01-01") + timedelta(minutes=i)) for i in range(20)],
                               "tx_id string, ts timestamp")
    assert [r.tx_id for r in FU.recent_alerts(df, 3).collect()] == ["t19", "t18", "t17"]
    assert FU.recent_alerts(df, 0).count() == 0


def test_top_k_factors(spark):
    df = spark.createDataFrame([([("a", 0.1), ("b", -0.5), ("c", 0.3)],)],
                               "contributions array<struct<feature:string, contribution:double>>")
    r = df.select(FU.top_k_factors("contributions", 2).alias("t")).first().t
    assert [(x.feature, x.direction) for x in r] == [("b", "decreases"), ("c", "increases")]
