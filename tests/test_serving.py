import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import features as FE
from ledgerlens.operators import serving as SE

SCHEMA = ("tx_id string, ts timestamp, sender_account string, receiver_account string, amount_paid double, "
          "amount_received double")


def _tx(spark, rows):
    return spark.createDataFrame([(i, None if t is None else pd.Timestamp("2024-01-01").to_pydatetime()
                                   + pd.Timedelta(hours=t).to_pytimedelta(), s, r, x, x)
                                  for i, t, s, r, x in rows], SCHEMA)


def _brute(rows, request, side):
    """What is known of the request's account from days before its own."""
    i, t, s, r, _ = request
    me = (s, r)[side]
    if t is None or me is None:
        return 0, 0.0, 0.0, 0, None
    old = [q for q in rows if q[1] is not None and q[2 + side] == me and q[1] // 24 < t // 24]
    xs = [q[4] for q in old if q[4] is not None]
    std = pd.Series(xs).std() if len(xs) > 1 else 0.0
    others = {q[3 - side] for q in old if q[3 - side] is not None}
    age = t // 24 - max(q[1] // 24 for q in old) if old else None
    return len(old), sum(xs), std, len(others), age


ROWS = [("a", 1, "A", "B", 10.0), ("b", 2, "A", "C", 20.0), ("b", 2, "A", "C", 20.0), ("c", 25, "A", "B", 5.0),
        ("d", 26, "B", "A", None), ("e", 99, "A", "D", 1e9), ("f", 123, "A", "D", 1e9 + 2), ("g", 150, "A", None, 3.0),
        ("h", 150, None, "A", 4.0), ("i", None, "A", "B", 7.0), ("j", 200, "Z", "B", 1.0)]


def test_as_of_equals_brute_force(spark):
    t = _tx(spark, ROWS)
    got = SE.serving_features(t, SE.profile_history(t, "sender"), SE.profile_history(t, "receiver")).collect()
    assert len(got) == len(ROWS)
    want = {q[0]: q for q in ROWS}
    for g in got:
        n, total, std, div, age = _brute(ROWS, want[g.tx_id], 0)
        assert (g.sender_tx_count, g.sender_receiver_diversity, g.sender_profile_age) == (n, div, age), g
        assert g.sender_total_amount == pytest.approx(total) and g.sender_std_amount == pytest.approx(std, abs=1e-3)
        n, total, _, div, age = _brute(ROWS, want[g.tx_id], 1)
        assert (g.receiver_tx_count, g.receiver_sender_diversity, g.receiver_profile_age) == (n, div, age), g
        assert g.receiver_total_amount == pytest.approx(total)


def test_requests_after_the_history_and_clashing_columns(spark):
    t = _tx(spark, ROWS[:4])
    asked = _tx(spark, [("x", 500, "A", "B", 1.0), ("y", 30, "A", "nobody", 1.0)]).withColumn("sender_tx_count", F.lit("old"))
    got = {r.tx_id: r for r in SE.serving_features(asked, SE.profile_history(t, "sender"),
                                                   SE.profile_history(t, "receiver")).collect()}
    assert (got["x"].sender_tx_count, got["x"].sender_profile_age, got["x"].receiver_tx_count) == (4, 19, 2)
    assert (got["y"].sender_tx_count, got["y"].receiver_tx_count, got["y"].receiver_profile_age) == (3, 0, None)


def test_empty_tables(spark):
    none, some = _tx(spark, []), _tx(spark, ROWS)
    assert SE.profile_history(none, "sender").count() == 0
    empty = [SE.profile_history(none, r) for r in ("sender", "receiver")]
    assert SE.serving_features(none, *empty).count() == 0
    got = SE.serving_features(some, *empty)
    assert got.count() == len(ROWS) and got.where("sender_tx_count <> 0").count() == 0
    assert set(FE.SENDER_COLS + FE.RECEIVER_COLS) <= set(got.columns)


def test_a_hot_account_is_joined_by_day(spark):
    """The plan joins requests on (account, day), never on the account alone."""
    t = _tx(spark, ROWS)
    plan = SE.attach_as_of(t, SE.profile_history(t, "sender"), "sender")._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    assert "_a" in top and "_d" in top
