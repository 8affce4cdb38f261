import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("ledgerlens-tests", cpus="*", shuffle_partitions=8, driver_memory="8g")
    yield s


def make_transactions(n: int = 500, pos_rate: float = 0.01, seed: int = 42, force_pos: int = 0) -> pd.DataFrame:
    """Hand-made transactions in the shape of the reference's fixture: hourly timestamps,
    accounts i mod 10 -> (i+1) mod 10 (one ring), exponential amounts, 1 % positives."""
    rng = np.random.default_rng(seed)
    ts = pd.date_range("2024-01-01", periods=n, freq="h")
    label = (rng.random(n) < pos_rate).astype(int)
    if force_pos:
        label[:force_pos] = 1
    return pd.DataFrame({
        "tx_id": [f"T{i:06d}" for i in range(n)],
        "ts": ts,
        "from_bank": rng.choice(["Bank A", "Bank B", "Bank C"], n),
        "sender_account": [f"ACC_{i % 10:03d}" for i in range(n)],
        "to_bank": rng.choice(["Bank A", "Bank B", "Bank D"], n),
        "receiver_account": [f"ACC_{(i + 1) % 10:03d}" for i in range(n)],
        "amount_received": rng.exponential(10000, n),
        "receiving_currency": rng.choice(["USD", "EUR", "GBP"], n),
        "amount_paid": rng.exponential(10000, n),
        "payment_currency": rng.choice(["USD", "EUR", "GBP"], n),
        "payment_format": rng.choice(["Wire Transfer", "ACH", "Cash"], n),
        "label": label,
    })


TX_SCHEMA = ("tx_id string, ts timestamp, from_bank string, sender_account string, to_bank string, "
             "receiver_account string, amount_received double, receiving_currency string, amount_paid double, "
             "payment_currency string, payment_format string, label int")


@pytest.fixture()
def tx_frame(spark):
    def mk(**kw):
        return spark.createDataFrame(make_transactions(**kw), TX_SCHEMA)
    return mk


def edges_df(spark, rows, with_ts=False):
    """rows: (src, dst[, ts_seconds, amount, label])"""
    out = []
    for i, r in enumerate(rows):
        src, dst = r[0], r[1]
        t = r[2] if len(r) > 2 else i
        amt = r[3] if len(r) > 3 else 100.0
        lab = r[4] if len(r) > 4 else 0
        out.append((f"E{i:05d}", pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=t), "B", src, "B", dst,
                    float(amt), "USD", float(amt), "USD", "Wire Transfer", int(lab)))
    return spark.createDataFrame(pd.DataFrame(out, columns=["tx_id", "ts", "from_bank", "sender_account", "to_bank",
                                                            "receiver_account", "amount_received", "receiving_currency",
                                                            "amount_paid", "payment_currency", "payment_format",
                                                            "label"]), TX_SCHEMA)
