"""The trie against plain dictionaries of prefixes, at shard sizes from one conversation up, and against its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from ledgerlens.llm import convtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(data):
    own = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)} {role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    seqs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if seqs[c] == p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(n=330, seed=4):
    rnd = random.Random(seed)
    data = []
    for c in range(n):
        if c == 200:
            continue                                  # an absent family head
        shape = rnd.random()
        if shape < 0.35:                              # a third of all conversations are the same
            turns = [("user", "hello"), ("bot", "hi there é"), ("user", "bye")] * 3
        elif shape < 0.6:
            turns = [("user", "hello")] + [(rnd.choice(["user", "bot"]), rnd.choice("abc")) for _ in range(rnd.randrange(9))]
        else:
            turns = [(rnd.choice(["user", None]), rnd.choice(["x", "y", None, ""])) for _ in range(rnd.randrange(1, 8))]
        data += [(c, k if k else None, r, t) for k, (r, t) in enumerate(turns)]
    data += [(7, 1, "user", "tie"), (7, 1, "bot", "tie"), (7, 1, "bot", "tie"), (None, 0, "user", "nobody"), (100_003, None, None, None)]
    data += [(500, k, "user", "t" * (k % 5)) for k in range(700)] + [(501, k, "user", "t" * (k % 5)) for k in range(300)]
    rnd.shuffle(data)
    return data


DATA = corpus()
WANT = brute(DATA)


def table(spark, data=DATA):
    return spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as depth", "'k' as key", "2 as shard", "'p' as path")


@pytest.mark.parametrize("shard_turns", [convtrie.SHARD_TURNS, 200, 1])
def test_equals_plain_prefixes(spark, shard_turns):
    out = convtrie.trie(table(spark), shard_turns)
    assert out.columns == convtrie.COLUMNS
    assert sorted(map(tuple, out.collect()), key=repr) == WANT


def test_sql_equals_plain_prefixes(spark):
    con = duckdb.connect()
    short = [r for r in DATA if r[0] not in (500, 501)]
    con.register("conversations", spark.createDataFrame(short, SCHEMA).toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    names = convtrie.COLUMNS
    got = con.execute(f"SELECT {', '.join(names)} FROM ({convtrie.SQL})").fetchall()
    assert sorted(got, key=repr) == brute(short)


def test_findclose_by_stack():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 40, 700, 5000):
        bits, depth = [], 0
        left = n
        while left or depth:
            up = left and (depth == 0 or rnd.random() < 0.55)
            bits.append(bool(up))
            depth, left = (depth + 1, left - 1) if up else (depth - 1, left)
        bits = np.array(bits)
        want, stack = {}, []
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opens = np.flatnonzero(bits)
        assert convtrie.Excess(bits).findclose(opens).tolist() == [want[i] for i in opens]


def test_empty_and_turnless(spark):
    assert convtrie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert convtrie.trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []
    lone = [(c, 0, "u", "only") for c in range(301, 320)]     # no family head: many are left without turns
    assert sorted(map(tuple, convtrie.trie(table(spark, lone), 2).collect()), key=repr) == brute(lone)
