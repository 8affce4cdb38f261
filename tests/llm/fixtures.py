"""Small tables for the operators' tests."""

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the thing over there was that and with for this which order ring stone anther onder thering erent".split()
DE = "der die und einer schon zeit auch nicht werden keiner über straße machen geschichte lichen heit".split()


def rows(n=60, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = EN if i % 3 else DE
        t = " ".join(rng.choice(words, rng.integers(20, 60)))
        if i % 10 == 4:
            t = t.replace(" ", " idiot ", 2) + ". You scum!\nworthless"
        if i % 10 == 7:
            t += " mail bob.42@mail8.example.com or +1 (988) 555-2485, 42.144.35.254, 4041894974608795, 999.1.1.1"
        out.append((i, t, "de" if i % 3 == 0 else "en", "hot" if i % 2 else f"s{i % 7}", len(t)))
    return out


def edge_rows():
    long = " ".join(EN * 1500)
    return [(1000, None, None, None, None), (1001, "", "en", "hot", 0), (1002, " \t\n\x0b ", "en", "hot", 5),
            (1003, long, "en", "hot", len(long)), (1004, long, "en", "s1", len(long)), (1005, "x" * 5000, None, None, 5000),
            (None, "no id here at all", "en", "s2", 17), (1006, "same row", "en", "s1", 8), (1006, "same row", "en", "s1", 8),
            (1007, "12345 -- !!! \u3000 \U0001f642 é", "en", "s1", 9), (1008, "a\u00a0b <|endoftext|> it's It'S ΟΔΟΣ", "en", "s1", 9)]


def documents(spark, data=None, extra=True):
    df = spark.createDataFrame(rows() + edge_rows() if data is None else data, SCHEMA)
    if extra:       # columns whose names operators use for their own
        df = df.selectExpr("*", "1 as score", "'z' as r", "2 as fp", "'k' as label", "array(1) as ids", "5 as bin", "6 as row")
    return df


def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 10 == 4)) for i in range(60)] + [(None, 1, 1), (3, None, None)],
                                 "doc_id long, quality int, toxic int")
