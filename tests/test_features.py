from datetime import datetime, timedelta


def dt(x):
    return datetime.fromisoformat(x)


import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ledgerlens.operators import features as FE
from ledgerlens.sources import transactions as SRC


def test_all_feature_columns_present(tx_frame):
    f = FE.engineer_features(tx_frame(n=100))
    assert all(c in f.columns for c in FE.FEATURE_COLUMNS)
    assert f.count() == 100


def test_log_features_non_negative(tx_frame):
    f = FE.engineer_features(tx_frame(n=200)).select("log_amount_paid", "log_amount_received").toPandas()
    assert (f >= 0).all().all()


def test_binary_flags(tx_frame):
    f = FE.engineer_features(tx_frame(n=200)).select("is_weekend", "is_cross_currency", "is_cross_bank").toPandas()
    for c in f.columns:
        assert set(f[c].unique()) <= {0, 1}


def test_label_kept(tx_frame):
    f = FE.engineer_features(tx_frame(n=200))
    assert "label" in f.columns
    assert f.where(F.col("label").isNull()).count() == 0


def test_profiles_match_pandas(tx_frame):
    pdf = tx_frame(n=300).toPandas()
    f = FE.engineer_features(tx_frame(n=300)).toPandas().set_index("tx_id")
    g = pdf.groupby("sender_account")["amount_paid"]
    exp = pdf.set_index("tx_id").join(g.agg(["count", "sum", "mean", "std"]).fillna(0), on="sender_account")
    assert (f.loc[exp.index, "sender_tx_count"] == exp["count"]).all()
    assert np.allclose(f.loc[exp.index, "sender_total_amount"], exp["sum"], atol=1e-3)
    assert np.allclose(f.loc[exp.index, "sender_mean_amount"], exp["mean"], atol=1e-5)
    assert np.allclose(f.loc[exp.index, "sender_std_amount"], exp["std"], atol=1e-3)
    div = pdf.groupby("sender_account")["receiver_account"].nunique()
    assert (f["sender_receiver_diversity"] == f["sender_account"].map(div)).all()


def test_null_sides_count_as_different(spark):
    df = spark.createDataFrame([("a", "USD", "USD"), ("b", None, "USD"), ("c", None, None), ("d", "EUR", "USD")],
                               "tx_id string, payment_currency string, receiving_currency string") \
        .withColumn("from_bank", F.lit("x")).withColumn("to_bank", F.lit(None).cast("string"))
    r = {x.tx_id: (x.is_cross_currency, x.is_cross_bank) for x in FE.cross_flags(df).collect()}
    assert r == {"a": (0, 1), "b": (1, 1), "c": (1, 1), "d": (1, 1)}


def test_weekday_monday_zero_and_single_row_std(spark):
    df = spark.createDataFrame([("t1", dt("2024-01-01 10:00"), "A", "B", 5.0, 5.0)],
                               "tx_id string, ts timestamp, sender_account string, receiver_account string, "
                               "amount_paid double, amount_received double")
    t = FE.time_features(df).first()
    assert (t.day_of_week, t.is_weekend, t.hour, t.day_of_month) == (0, 0, 10, 1)
    p = FE.sender_profile(df).first()
    assert p.sender_std_amount == 0.0 and p.sender_tx_count == 1


def test_bad_amount_and_ratio(spark):
    df = spark.createDataFrame([(-2.0, 0.0), (float("nan"), 10.0), (None, 5.0), (50.0, 10.0)],
                               "amount_paid double, amount_received double")
    r = FE.amount_features(df).collect()
    assert r[0].bad_amount == 1 and r[0].log_amount_paid == 0.0 and r[0].amount_ratio == 1.0
    assert r[1].amount_paid == 0.0 and r[2].amount_paid == 0.0
    assert math.isclose(r[3].log_amount_ratio, math.log(5.0))


def test_category_codes_alphabetical_shared(spark):
    df = spark.createDataFrame([("a", "USD", "EUR", None), ("b", "GBP", "USD", "ACH")],
                               "tx_id string, payment_currency string, receiving_currency string, payment_format string")
    r = {x.tx_id: x for x in FE.encode_categories(df).collect()}
    assert (r["a"].payment_currency_enc, r["a"].receiving_currency_enc) == (2, 0)
    assert (r["b"].payment_currency_enc, r["b"].receiving_currency_enc) == (1, 2)
    assert (r["a"].payment_format_enc, r["b"].payment_format_enc) == (1, 0)   # ACH < Unknown


def test_scaler_fitted_on_train_and_test_mean_small(tx_frame):
    f = FE.engineer_features(tx_frame(n=1000, force_pos=10))
    s = FE.stratified_split(f, 0.2, 42)
    train = s.where("is_test = 0")
    stats = FE.scaler_stats(train, FE.FEATURE_COLUMNS)
    z = FE.scaler_apply(s.where("is_test = 1"), stats, "_z").select(*[f"{c}_z" for c in FE.FEATURE_COLUMNS]).toPandas()
    assert abs(z.mean().mean()) < 0.5
    assert all(sd > 0 for _, sd in stats.values())


def test_stratified_split_rates(tx_frame):
    f = tx_frame(n=1000, force_pos=10)
    s = FE.stratified_split(f, 0.2, 42).toPandas()
    test = s[s.is_test == 1]
    P = int(s.label.sum())
    assert len(test) == math.ceil(0.2 * P) + math.ceil(0.2 * (len(s) - P))
    assert abs(test.label.mean() - s.label.mean()) < 0.02
    assert test.label.sum() >= 1 and (s[s.is_test == 0].label.sum()) >= 1


def test_split_is_exact_global_rank(tx_frame):
    f = tx_frame(n=700)
    s = FE.random_split(f, 0.2, 7, bucket_hex=1).toPandas()
    import hashlib
    order = sorted(s.tx_id, key=lambda k: (hashlib.md5(f"7:{k}".encode()).hexdigest(), k))
    assert set(s[s.is_test == 1].tx_id) == set(order[: int(0.2 * 700)])


def test_rolling_strictly_earlier(spark):
    rows = [("t1", dt("2024-01-01 00:00"), "A", 10.0), ("t2", dt("2024-01-01 12:00"), "A", 20.0),
            ("t3", dt("2024-01-02 06:00"), "A", 30.0), ("t4", dt("2024-01-02 06:00"), "A", 5.0),
            ("t5", dt("2024-02-20 00:00"), "A", 1.0)]
    df = spark.createDataFrame(rows, "tx_id string, ts timestamp, sender_account string, amount_paid double")
    r = {x.tx_id: x for x in FE.rolling_window_stats(df, "sender_account", "amount_paid",
                                                      {"1d": FE.DAY_US, "30d": 30 * FE.DAY_US}).collect()}
    assert (r["t1"].cnt_1d, r["t2"].cnt_1d, r["t3"].cnt_1d, r["t4"].cnt_1d) == (0, 1, 1, 1)
    assert r["t3"].sum_1d == 20.0 and r["t3"].cnt_30d == 2 and r["t4"].max_30d == 20.0
    assert r["t5"].cnt_30d == 0


def test_read_transactions_csv_by_position(spark, tmp_path):
    p = tmp_path / "tx.csv"
    p.write_text("Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,"
                 "Payment Currency,Payment Format,Is Laundering\n"
                 "2022/09/01 00:20,10,8000EBD30,10,8000EBD30,3697.34,US Dollar,3697.34,US Dollar,Reinvestment,0\n"
                 "2022/09/01 00:20,3208,8000F4580,1,8000F5340,abc,US Dollar,0.01,US Dollar,Cheque,1\n")
    df = SRC.read_transactions(spark, str(p), time_kind="timestamp", fmt="csv")
    r = df.orderBy("label").collect()
    assert r[0].ts == datetime(2022, 9, 1, 0, 20)
    assert r[0].sender_account == "8000EBD30" and r[1].receiver_account == "8000F5340"
    assert r[1].amount_received == 0.0 and r[1].label == 1
    summary = SRC.label_summary(df).first()
    assert (summary.n_rows, summary.n_positive, summary.positive_rate_pct) == (2, 1, 50.0)


def test_validate_and_normalize(spark):
    df = spark.createDataFrame([("a", dt("2024-01-01"), "S", "R", 0.0, 5.0, "", None, "", None, None, 0),
                                ("b", dt("2024-01-01"), " ", "R", 1.0, 1.0, "EUR", "EUR", "ACH", "x", "y", 0)],
                               "tx_id string, ts timestamp, sender_account string, receiver_account string, "
                               "amount_paid double, amount_received double, payment_currency string, "
                               "receiving_currency string, payment_format string, from_bank string, to_bank string, label int")
    n = {r.tx_id: r for r in SRC.normalize_transactions(df).collect()}
    assert n["a"].amount_paid == 1.0 and n["a"].payment_currency == "USD" and n["a"].payment_format == "Wire Transfer"
    valid, rejected = SRC.validate_transactions(SRC.normalize_transactions(df))
    assert [r.tx_id for r in valid.collect()] == ["a"]
    assert rejected.first().reasons == ["missing_sender"]


def test_history_stats_match_brute_force_across_buckets(spark):
    import numpy as np
    rng = np.random.default_rng(9)
    base = datetime(2024, 1, 1)
    rows = [(f"t{i:03d}", base + timedelta(hours=int(h)), f"A{a}", f"R{r}", float(v))
            for i, (h, a, r, v) in enumerate(zip(rng.integers(0, 200, 300), rng.integers(0, 3, 300),
                                                  rng.integers(0, 8, 300), np.round(rng.random(300) * 100, 2)))]
    df = spark.createDataFrame(rows, "tx_id string, ts timestamp, sender_account string, receiver_account string, "
                                     "amount_paid double")
    got = {r.tx_id: r for r in FE.history_stats(df, "sender_account", "amount_paid", "receiver_account", "s", "div",
                                                 bucket_us=7 * 3600 * 10**6).collect()}
    for tid, ts, a, rc, v in rows:
        prev = [x for x in rows if x[2] == a and x[1] < ts]
        g = got[tid]
        assert g.s_tx_count == len(prev)
        assert g.div == len({x[3] for x in prev})
        assert abs(g.s_total_amount - sum(x[4] for x in prev)) < 1e-6
        if len(prev) > 1:
            assert abs(g.s_std_amount - float(np.std([x[4] for x in prev], ddof=1))) < 1e-3


def test_rolling_split_buckets_same_result(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    base = datetime(2024, 1, 1)
    rows = [(f"t{i:03d}", base + timedelta(minutes=int(m)), "HOT", float(v))
            for i, (m, v) in enumerate(zip(rng.integers(0, 60 * 24 * 20, 300), np.round(rng.random(300) * 50, 2)))]
    df = spark.createDataFrame(rows, "tx_id string, ts timestamp, sender_account string, amount_paid double")
    w = {"1d": FE.DAY_US, "7d": 7 * FE.DAY_US}
    a = {r.tx_id: tuple(r)[1:] for r in FE.rolling_window_stats(df, "sender_account", "amount_paid", w).collect()}
    b = {r.tx_id: tuple(r)[1:] for r in FE.rolling_window_stats(df, "sender_account", "amount_paid", w, split=5).collect()}
    assert a == b and len(a) == 300
    t0 = rows[150]
    prev = [x for x in rows if x[1] < t0[1] and x[1] >= t0[1] - timedelta(days=7)]
    assert a[t0[0]][5] == len(prev)


def test_rolling_windows_against_brute_force(spark):
    """All statistics and distinct counterparties, with ties, missing amounts and counterparties, for every split."""
    import numpy as np
    rng = np.random.default_rng(5)
    base = datetime(2024, 1, 1)
    rows = [(f"t{i:03d}", base + timedelta(hours=int(h)), "HOT" if a else f"A{i % 3}", f"R{r}" if r else None, v)
            for i, (h, a, r, v) in enumerate(zip(rng.integers(0, 24 * 12, 400), rng.integers(0, 3, 400), rng.integers(0, 9, 400),
                                                  [None if u < .05 else round(u * 50, 2) for u in rng.random(400).tolist()]))]
    rows += [("n1", None, "HOT", "R1", 1.0), ("n2", base, None, "R1", 1.0)]
    df = spark.createDataFrame(rows, "tx_id string, ts timestamp, sender_account string, receiver_account string, "
                                     "amount_paid double")
    widths = {"1d": 1, "3d": 3, "all": 10_000}
    for split in (1, 4):
        got = {r.tx_id: r for r in FE.rolling_window_stats(
            df, "sender_account", "amount_paid", {"1d": FE.DAY_US, "3d": 3 * FE.DAY_US, "all": None}, split=split,
            other="receiver_account").collect()}
        assert set(got) == {r[0] for r in rows[:400]}
        for tid, ts, a, _, _ in rows[:400]:
            for name, days in widths.items():
                prev = [x for x in rows[:400] if x[2] == a and ts - timedelta(days=days) <= x[1] < ts]
                xs = [x[4] for x in prev if x[4] is not None]
                g = got[tid]
                assert g[f"cnt_{name}"] == len(xs) and g[f"max_{name}"] == max(xs, default=0.0)
                assert abs(g[f"sum_{name}"] - sum(xs)) < 1e-3
                assert abs(g[f"std_{name}"] - (np.std(xs, ddof=1) if len(xs) > 1 else 0)) < 1e-3
                assert g[f"div_{name}"] == len({x[3] for x in prev} - {None})


def test_rolling_std_of_large_equal_amounts_is_zero(spark):
    base = datetime(2024, 1, 1)
    rows = [(f"t{i}", base + timedelta(hours=i), "A", 123456789.01) for i in range(60)]
    df = spark.createDataFrame(rows, "tx_id string, ts timestamp, sender_account string, amount_paid double")
    got = FE.rolling_window_stats(df, "sender_account", "amount_paid", {"1d": FE.DAY_US}).collect()
    assert {r.std_1d for r in got} == {0.0} and max(r.cnt_1d for r in got) == 24


def test_history_std_of_large_amounts_close_together(spark):
    amounts = [1e9 + i % 3 for i in range(12)]
    rows = [(f"T{i:02d}", "A", f"R{i}", 1_700_000_000 + i * 50_000, x) for i, x in enumerate(amounts)]
    df = spark.createDataFrame(rows, "tx_id string, sender_account string, receiver_account string, t long, amount_paid double") \
        .withColumn("ts", F.timestamp_seconds("t"))
    got = {r.tx_id: r.s_std_amount for r in FE.history_stats(df, "sender_account", "amount_paid", "receiver_account", "s",
                                                             "div").collect()}
    for i in range(2, 12):
        assert abs(got[f"T{i:02d}"] - np.std(amounts[:i], ddof=1)) < 1e-3


def test_rolling_moves_a_row_once_for_all_windows(spark, tx_frame):
    """One move to the account and one back to the id, however many windows; no window function."""
    df = tx_frame(n=50)
    for windows in ({"1d": FE.DAY_US}, {f"{k}d": k * FE.DAY_US for k in (1, 3, 7, 30)}):
        got = FE.rolling_window_stats(df, "sender_account", "amount_paid", windows, other="receiver_account")
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression") == 2 and "Window [" not in plan
        assert got.count() == 50


def test_rolling_over_many_segments_and_chunks(spark, monkeypatch):
    """Long histories, so that windows reach over segments, and chunks of a few rows, so that they reach over chunks."""
    import pyarrow as pa
    rng = np.random.default_rng(11)
    day = FE.DAY_US
    rows = sorted((f"K{k}", int(t), f"t{i}", f"R{o}", float(v)) for i, (k, t, o, v) in enumerate(zip(
        rng.integers(0, 2, 300), rng.integers(-60, 60, 300) * day // 4, rng.integers(0, 4, 300), rng.integers(1, 90, 300))))
    widths = {"1d": day, "2d": 2 * day}

    def expected(k, t, w):
        prev = [r for r in rows if r[0] == k and t - w <= r[1] < t]
        return len(prev), sum(r[4] for r in prev), max((r[4] for r in prev), default=None), len({r[3] for r in prev})

    df = spark.createDataFrame([(i, k, t, o, v) for k, t, i, o, v in rows], "tx_id string, k string, t long, o string, x double") \
        .withColumn("ts", F.timestamp_micros("t"))
    got = {r.tx_id: r for r in FE.rolling_window_stats(df, "k", "x", widths, other="o").collect()}
    monkeypatch.setattr(FE, "CHUNK_ROWS", 7)
    batches = [pa.RecordBatch.from_pydict({
        "_id": [r[2] for r in part], "_k": [r[0] for r in part], "_t": [r[1] for r in part], "_x": [r[4] for r in part],
        "_o": [r[3] for r in part], "_g": pa.array([0] * len(part), pa.int64()), "_own": [True] * len(part),
        "_h": pa.array([int(r[4]) for r in part], pa.int64()), "_l": pa.array([0] * len(part), pa.int64())})
        for part in (rows[a:a + 5] for a in range(0, len(rows), 5))]
    chunks = list(FE._window_rows(list(widths.values()), True)(iter(batches)))
    assert len(chunks) > 10
    chunked = {r["_id"]: r for b in chunks for r in b.to_pylist()}
    assert len(got) == len(chunked) == 300
    for k, t, i, _, _ in rows:
        for n, (name, w) in enumerate(widths.items()):
            want = expected(k, t, w)
            g, c = got[i], chunked[i]
            assert (g[f"cnt_{name}"], g[f"sum_{name}"], g[f"max_{name}"] or None, g[f"div_{name}"]) == want
            assert (c[f"n{n}"], float(c[f"h{n}"]), c[f"x{n}"], c[f"d{n}"]) == want


def test_split_moves_rows_without_their_hash(spark, tx_frame):
    rows = tx_frame(n=50).select("tx_id", "label")
    for split in (FE.random_split(rows), FE.stratified_split(rows)):
        plan = split._jdf.queryExecution().optimizedPlan()
        stack, widths = [plan], []
        while stack:
            p = stack.pop()
            if p.nodeName() == "RepartitionByExpression":
                widths.append(sorted(p.output().apply(i).name() for i in range(p.output().length())))
            stack += [p.children().apply(i) for i in range(p.children().length())]
        assert widths == [["_b", "label", "tx_id"]]


def _earlier_brute(rows, i, key, other, amount):
    """Count, sum, std and counterparties of the strictly earlier rows of row i's account."""
    r = rows[i]
    if r[key] is None or r["ts"] is None:
        return None
    prev = [x for x in rows if x[key] == r[key] and x["ts"] is not None and x["ts"] < r["ts"]]
    amounts = [x[amount] or 0.0 for x in prev]
    return (len(prev), round(sum(amounts), 4), float(np.std(amounts, ddof=1)) if len(prev) > 1 else 0.0,
            len({x[other] for x in prev} - {None}))


def test_point_in_time_rows_take_their_history_along(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pick = lambda v: None if rng.random() < 0.1 else v
    rows = [{"tx_id": f"t{i:03d}", "ts": pick(datetime(2024, 1, 1) + timedelta(hours=int(rng.integers(0, 60)))),
             "sender_account": pick(f"A{int(4 * rng.random() ** 2)}"), "receiver_account": pick(f"A{rng.integers(0, 4)}"),
             "amount_paid": pick(float(rng.integers(0, 500)) / 4), "amount_received": float(rng.integers(0, 500)) / 4} for i in range(150)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "tx_id string, ts timestamp, sender_account string, "
                               "receiver_account string, amount_paid double, amount_received double")
    want = {r["tx_id"]: (_earlier_brute(rows, i, "sender_account", "receiver_account", "amount_paid"),
                         _earlier_brute(rows, i, "receiver_account", "sender_account", "amount_received")) for i, r in enumerate(rows)}
    for hot in (1_000_000, 20):          # none, and some accounts and the rows without a history above the limit
        monkeypatch.setattr(FE, "HOT_ROWS", hot)
        p = FE.point_in_time_profiles(df)
        # a row is moved to its two accounts, and not to be joined by id
        assert "Join" not in p._jdf.queryExecution().optimizedPlan().toString() or hot == 20
        got = {r.tx_id: r for r in p.collect()}
        assert len(got) == p.count() == len(rows)
        for tid, (s, r) in want.items():
            g = got[tid]
            mine = (g.sender_tx_count, g.sender_total_amount, g.sender_std_amount, g.sender_receiver_diversity)
            assert mine == (None,) * 4 if s is None else (mine[:2] == s[:2] and abs(mine[2] - s[2]) < 1e-3 and mine[3] == s[3]), (hot, mine, s)
            mine = (g.receiver_tx_count, g.receiver_total_amount, g.receiver_sender_diversity)
            assert mine == (None,) * 3 if r is None else mine == (r[0], r[1], r[3])


def test_point_in_time_rows_with_one_id_are_joined(spark):
    rows = [("a", 1, "S", "R"), ("a", 2, "S", "R"), ("b", 3, "S", "R"), (None, 4, "S", "R")]
    df = spark.createDataFrame([(i, datetime(2024, 1, 1, h), s, r, 1.0, 1.0) for i, h, s, r in rows],
                               "tx_id string, ts timestamp, sender_account string, receiver_account string, "
                               "amount_paid double, amount_received double")
    got = sorted((str(r.tx_id), r.ts.hour, r.sender_tx_count, r.receiver_tx_count) for r in FE.point_in_time_profiles(df).collect())
    assert got == sorted([("None", 4, None, None), ("b", 3, 2, 2), *[("a", h, s, r) for h in (1, 2) for s in (0, 1) for r in (0, 1)]], key=str)
