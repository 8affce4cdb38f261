"""Phrases against plain counting, at budgets that extend prefixes to every depth, and against the SQL."""

import os
import random
import re
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from fixtures import EN, SCHEMA, documents, edge_rows, rows  # noqa: E402

from ledgerlens.llm import phrases  # noqa: E402

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(data, min_count=phrases.MIN_COUNT, top=phrases.TOP):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in data:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for i in range(len(w)):
                for d in range(1, 5):
                    if i + d <= len(w):
                        f[lang][tuple(w[i:i + d])] += 1
    out = []
    for lang, c in f.items():
        many = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in many.items():
            inside = any(100 * b >= 80 * a for q, b in many.items() if len(q) > len(p)
                         and any(q[i:i + len(p)] == p for i in range(len(q))))
            if not inside:
                s, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def corpus():
    rnd = random.Random(3)
    data = rows() + edge_rows()
    for i in range(300):
        words = rnd.choices(EN[:6], k=40)
        words[5:5] = ["New", "york", "city", "hall"]
        if i % 3 == 0:
            words[20:20] = ["in", "New", "York.", "ö\x01x", "straße"]
        data.append((2000 + i, " ".join(words) + ("," if i % 2 else "\t") + " hot hot hot hot hot", rnd.choice(["en", "de", None]),
                     "s", 1))
    return data


DATA = corpus()
WANT = brute(DATA)


@pytest.mark.parametrize("memory", [phrases.MEMORY_SUFFIXES, 300, 40])
def test_equals_plain_counting(spark, memory):
    got = phrases.collocations(documents(spark, DATA), memory=memory)
    assert sorted(map(tuple, got.collect())) == WANT


def test_top_and_least_count(spark):
    got = phrases.collocations(documents(spark, DATA), min_count=45, top=7, memory=100).collect()
    assert sorted(map(tuple, got)) == brute(DATA, 45, 7)


def test_sql_equals_plain_counting(spark):
    con = duckdb.connect()
    con.register("documents", documents(spark, DATA, extra=False).toPandas())
    got = con.execute(phrases.SQL).fetchall()
    assert sorted(tuple(x if isinstance(x, str) else int(x) for x in r) for r in got) == WANT


def test_budget_holds():
    totals = np.array([5, 5, 1, 30, 2, 0, 9])
    group = phrases.pack_buckets(totals, 10)
    filled = [totals[group == g].sum() for g in np.unique(group)]
    assert all(t <= 10 or (group == g).sum() == 1 or t == 30 for g, t in enumerate(filled)) and sum(filled) == totals.sum()


def test_prefixes():
    heavy = [{b"a"}, {b"a b"}, {b"a b c"}]
    assert phrases._prefix(b"x y", heavy) == (b"x", 1)
    assert phrases._prefix(b"a c d", heavy) == (b"a c", 2)
    assert phrases._prefix(b"a c", heavy) == (b"a c", 2)
    assert phrases._prefix(b"a b c d", heavy) == (b"a b c d", 4)
    assert phrases._prefix(b"a b", heavy) is None and phrases._prefix(b"a b c", heavy) is None


def test_filter_passes_every_frequent_word(spark):
    words = [f"w{i}é" for i in range(5000)]
    bits = phrases.frequent_filter(spark.createDataFrame([(w,) for w in words], "phrase string"))
    known = phrases._Known(bits)
    assert all(known[w.encode()] for w in words)
    assert sum(known[f"v{i}".encode()] for i in range(5000)) < 800


def test_hash_of_prefix_is_the_same_on_both_sides(spark):
    df = spark.createDataFrame([("en", "a b"), ("de", "ü"), ("", "x")], "lang string, phrase string")
    got = [r[0] for r in df.select(phrases._unsigned_mod(phrases._key(F.col("lang"), F.col("phrase")), 1000)).collect()]
    assert got == [phrases._hash(k) % 1000 for k in (b"en\0a b", "de\0ü".encode(), b"\0x")]


def test_empty_tables(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None, 0)], SCHEMA)).collect() == []
