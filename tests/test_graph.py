from collections import defaultdict

import pandas as pd
from pyspark.sql import functions as F

from conftest import edges_df
from ledgerlens.operators import graph as GR

RING4 = [("A", "B", 0, 12000.0), ("B", "C", 600, 12000.0), ("C", "D", 1200, 12000.0), ("D", "A", 1800, 12000.0)]


def _ego_brute(edges, seed, hops):
    adj = defaultdict(set)
    for s, d in edges:
        adj[s].add(d)
        adj[d].add(s)
    if seed not in adj:
        return set(), set()
    seen, frontier = {seed}, {seed}
    for _ in range(hops):
        nxt = set().union(*[adj[n] for n in frontier]) - seen
        seen |= nxt
        frontier = nxt
    return seen, {(s, d) for s, d in edges if s in seen and d in seen}


def test_ring_cycles(spark):
    t = edges_df(spark, RING4 + [("A", "C", 2000), ("C", "A", 2100), ("E", "E", 10)])
    e = GR.simple_edges(t)
    c = {tuple(r) for r in GR.cycles_3(e).collect()}
    assert c == {("A", "B", "C"), ("A", "C", "D")}   # A->B->C->A and A->C->D->A; the self-loop is ignored
    cand = spark.createDataFrame([("x", "D", "A"), ("y", "A", "E")], "cand_id string, src string, dst string")
    m = {r.cand_id: (r.in_cycle, r.cycle_len) for r in GR.cycle_membership(e, cand, max_len=4).collect()}
    assert m["x"] == (1, 3) and m["y"] == (0, None)    # D->A closes the 3-cycle D->A->C->D


def test_fan_out_and_fan_in(spark):
    rows = [("SRC", f"T{i:02d}", i * 60, 15000.0) for i in range(15)] + [("X", "T00", 5, 1.0)]
    t = edges_df(spark, rows)
    fo = GR.fan_out(t, "30 days", 10).collect()
    assert [(r.account_id, r.n_counterparties, r.n_tx) for r in fo] == [("SRC", 15, 15)]
    assert fo[0].total_amount == 225000.0
    fi = GR.fan_in(t, "30 days", 2).collect()
    assert [(r.account_id, r.n_counterparties) for r in fi] == [("T00", 2)]


def test_split_merge(spark):
    rows = [("S", f"M{i}", 0, 9500.0) for i in range(5)] + [(f"M{i}", "D", 100, 9450.0) for i in range(5)]
    rows += [("S", "M9", 0, 9500.0), ("M9", "D", 100, 100.0)]          # amount too small
    t = edges_df(spark, rows)
    r = GR.split_merge(t, max_gap_us=3600 * 10**6, min_intermediates=2).collect()
    assert [(x.src_account, x.dst_account, x.n_intermediates) for x in r] == [("S", "D", 5)]


def test_structuring(spark):
    rows = [("A", "B", i * 3600, 9500.0) for i in range(3)] + [("C", "B", 0, 9500.0), ("A", "B", 10, 10000.0)]
    r = GR.structuring(edges_df(spark, rows), 10000.0, 0.1, 2, "90 days").collect()
    assert [(x.account_id, x.n_tx) for x in r] == [("A", 3)]


def test_ego_subgraph_matches_bfs(spark):
    import random
    random.seed(5)
    pairs = {(f"N{random.randrange(40)}", f"N{random.randrange(40)}") for _ in range(90)}
    t = edges_df(spark, sorted(pairs))
    e = GR.simple_edges(t)
    seeds = spark.createDataFrame([("N1",), ("N7",), ("ZZ",)], "seed string")
    nodes, sub = GR.ego_subgraph(e, seeds, hops=2)
    got_n = defaultdict(set)
    for r in nodes.collect():
        got_n[r.seed].add(r.node)
    got_e = defaultdict(set)
    for r in sub.collect():
        got_e[r.seed].add((r.src, r.dst))
    for s in ("N1", "N7", "ZZ"):
        bn, be = _ego_brute(pairs, s, 2)
        assert got_n.get(s, set()) == bn and got_e.get(s, set()) == be


def test_latest_edge_and_roles(spark):
    rows = [("A", "B", 0, 1.0, 0), ("A", "B", 50, 2.0, 1), ("B", "C", 10, 3.0, 0), ("C", "A", 20, 4.0, 0)]
    e = GR.simple_edges(edges_df(spark, rows))
    ab = e.where((F.col("src") == "A") & (F.col("dst") == "B")).first()
    assert (ab.amount_paid, ab.label, ab.n_tx) == (2.0, 1, 2)
    seeds = spark.createDataFrame([("B",)], "seed string")
    nodes, sub = GR.ego_subgraph(e, seeds, 1)
    flagged = spark.createDataFrame([("C",)], "account_id string")
    roles = {r.node: (r.role, r.out_degree, r.in_degree, r.fraud_out) for r in GR.node_roles(nodes, sub, flagged).collect()}
    assert roles == {"B": ("seed", 1, 1, 0), "C": ("flagged", 1, 1, 0), "A": ("fraud_linked", 1, 1, 1)}
    s = GR.graph_summary(e).first()
    assert (s.n_nodes, s.n_edges, s.n_fraud_edges) == (3, 3, 1)


def test_neighbour_mean_with_multiplicity(spark):
    t = edges_df(spark, [("A", "C"), ("A", "C"), ("B", "C"), ("C", "A")])
    x = spark.createDataFrame([("A", 1.0), ("B", 4.0), ("C", 10.0)], "account_id string, f double")
    m = {r.account_id: r.f_nb for r in GR.neighbour_mean(GR.multi_edges(t), x, ["f"]).collect()}
    assert m == {"A": 10.0, "B": 0.0, "C": 2.0}
    k = GR.khop_embedding(GR.multi_edges(t), x, ["f"], k=2).where("account_id = 'A'").first()
    assert (k.f_h0, k.f_h1, k.f_h2) == (1.0, 10.0, 2.0)


def test_fraud_nodes_and_edge_score(spark):
    t = edges_df(spark, [("A", "B", 0, 1.0, 1), ("B", "C", 1, 1.0, 0)])
    fn = {r.account_id: r.is_fraud_node for r in GR.label_fraud_nodes(t).collect()}
    assert fn == {"A": 1, "B": 1, "C": 0}
    sc = spark.createDataFrame([("A", 1.0), ("B", 0.5), ("C", 0.0)], "account_id string, score double")
    es = {r.tx_id: r.edge_score for r in GR.edge_score(t, sc).collect()}
    assert es == {"E00000": 0.75, "E00001": 0.25}


def test_ordered_index_across_partitions(spark):
    import random
    random.seed(3)
    ids = [f"ACC_{random.randrange(10**6)}" for _ in range(700)]
    df = spark.createDataFrame([(i,) for i in ids], "account_id string")
    got = {r.account_id: r.idx for r in GR.ordered_index(df, "account_id", partitions=7).collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(ids)))}


def test_ring_of_five_is_found_once_and_in_time_order(spark):
    from conftest import edges_df
    day = 86_400
    ring = [("A", "B", 0, 1000.0), ("B", "C", day, 980.0), ("C", "D", 2 * day, 960.0), ("D", "E", 3 * day, 940.0),
            ("E", "A", 4 * day, 920.0)]
    noise = [("B", "A", 5 * day, 5.0), ("E", "A", day, 920.0), ("D", "E", 90 * day, 940.0)]
    t = edges_df(spark, ring + noise)
    got = GR.ring_cycles(t, 5).collect()
    assert [(r.tx_ids, r.accounts) for r in got] == [("E00000,E00001,E00002,E00003,E00004", "A,B,C,D,E")]
    assert GR.ring_cycles(t, 4).count() == 0
    cand = t.where("tx_id = 'E00000'").selectExpr("tx_id AS cand_id", "sender_account AS src", "receiver_account AS dst")
    rest = GR.simple_edges(t.where("tx_id NOT IN ('E00000', 'E00005')"))
    assert GR.cycle_membership(rest, cand, max_len=5).first()["cycle_len"] == 5


def test_rings_equal_brute_force(spark):
    import random

    from conftest import edges_df
    rnd = random.Random(3)
    rows = [(f"N{rnd.randrange(7)}", f"N{rnd.randrange(7)}", rnd.randrange(60) * 43_200, float(rnd.choice([0, 90, 95, 100])))
            for _ in range(110)]
    want = set()

    def grow(path):
        last = rows[path[-1]]
        if len(path) == 3:
            if last[1] == rows[path[0]][0]:
                want.add(",".join(f"E{k:05d}" for k in path))
            return
        seen = {rows[k][0] for k in path} | {last[1]}
        for k, r in enumerate(rows):
            if (r[0] == last[1] and r[0] != r[1] and 0 < r[2] - last[2] <= 20 * 86_400 and 0.9 * last[3] <= r[3] <= last[3]
                    and (r[1] not in seen or (len(path) == 2 and r[1] == rows[path[0]][0]))):
                grow(path + [k])

    for k, r in enumerate(rows):
        if r[0] != r[1]:
            grow([k])
    got = [r.tx_ids for r in GR.ring_cycles(edges_df(spark, rows), 3, 20 * GR.DAY_US, 0.9, 1.0).collect()]
    assert want and sorted(got) == sorted(want)


def test_induced_edges_move_lists_of_seeds(spark, monkeypatch):
    import random
    rng = random.Random(3)
    edges = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(150)})
    sets = sorted({(s, f"n{rng.randrange(30)}") for s in range(20) for _ in range(12)} | {(s, "n0") for s in range(20)})
    e, n = (spark.createDataFrame(edges, "src string, dst string").withColumn("label", F.lit(0)),
            spark.createDataFrame(sets, "seed int, node string"))
    inside = set(sets)
    want = sorted((s, a, b) for s in range(20) for a, b in edges if (s, a) in inside and (s, b) in inside)
    for members in (4096, 7):        # 7: some nodes are hubs without a list
        monkeypatch.setattr(GR, "LIST_MEMBERS", members)
        out = GR.induced_edges(e, n)
        assert sorted((r.seed, r.src, r.dst) for r in out.collect()) == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "array_intersect" in plan and ("LeftSemi" in plan) == (members == 7)


def test_alert_neighbourhood_equals_brute_force(spark):
    edges = [("A", "B"), ("C", "B"), ("A", "D"), ("D", "C"), ("E", "F"), ("F", "E"), ("B", "B"), ("E", "G")]
    e = spark.createDataFrame([(s, d, int((s, d) == ("D", "C"))) for s, d in edges], "src string, dst string, label int")
    alerts = [(1, "A", "B"), (2, "E", "F"), (3, "A", None), (4, "Z", "Y"), (5, "A", "B"), (5, "A", "B")]
    nodes, sub = GR.alert_neighbourhood(e, spark.createDataFrame(alerts, "tx_id int, sender_account string, receiver_account string"))
    want, rows = {}, []
    for i in {a[0] for a in alerts}:
        ends = {x for a in alerts if a[0] == i for x in a[1:]}
        want[i] = ({x for p in edges if ends & set(p) for x in p})
    assert {(r.seed, r.node) for r in nodes.collect()} == {(i, x) for i, xs in want.items() for x in xs}
    for i, s, r in alerts:
        rows += [(i, a, b, None if r is None and not (a, b) == ("D", "C") and a == s else int((a, b) == (s, r) or (a, b) == ("D", "C")))
                 for a, b in edges if a in want[i] and b in want[i]]
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(((r.seed, r.src, r.dst, r.highlight) for r in sub.collect()), key=key) == sorted(rows, key=key)


def test_edges_carry_their_latest_transfer_once(spark):
    t = edges_df(spark, [("A", "B", 5, 1.0), ("A", "B", 9, 2.0), ("A", "B", 9, 3.0), ("B", "A", 1, 4.0), ("B", "C", 1, 4.0)])
    e = GR.simple_edges(t)
    last = t.where("sender_account = 'A'").orderBy(F.desc("ts"), F.desc("tx_id")).first()
    got = {(r.src, r.dst): (r.tx_id, r.amount_paid, r.n_tx) for r in e.collect()}
    assert got[("A", "B")] == (last.tx_id, last.amount_paid, 3) and len(got) == 3
    assert "max_by" not in e._jdf.queryExecution().optimizedPlan().toString()
    trimmed = GR.trimmed_edges(GR.multi_edges(t))       # distinct only what is left
    plan = trimmed._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in trimmed.collect()} == {("A", "B"), ("B", "A")}
    assert plan.index("Aggregate [") < plan.index("LeftSemi")


def test_following_legs_are_copied_little_and_meet_once(spark):
    import random
    rng = random.Random(5)
    rows = [(i, rng.randrange(10**6), rng.choice([0.0, rng.uniform(1, 1000)])) for i in range(400)]
    legs = spark.createDataFrame(rows, "id int, t long, a double")
    first, after = GR._leg_keys(legs, 20_000, 0.9, 1.0)
    assert after.count() < 3 * len(rows)            # four copies each before
    f = first.select(F.col("id").alias("x"), F.col("t").alias("t1"), F.col("a").alias("a1"), "tb", "ab")
    g = after.select(F.col("id").alias("y"), F.col("t").alias("t2"), F.col("a").alias("a2"), "tb", "ab")
    met = f.join(g, ["tb", "ab"]).where(GR._follows("t1", "a1", "t2", "a2", 20_000, 0.9, 1.0))
    want = sorted((i, j) for i, t, a in rows for j, u, b in rows if 0 <= u - t <= 20_000 and a * 0.9 <= b <= a)
    assert sorted((r.x, r.y) for r in met.collect()) == want


def test_split_merge_keys_only_legs_through_intermediates(spark):
    rows = [("S", f"M{i}", 0, 9500.0) for i in range(3)] + [(f"M{i}", "D", 100, 9450.0) for i in range(3)] + [("X", "Y", 0, 1.0)]
    out = GR.split_merge(edges_df(spark, rows), max_gap_us=3600 * 10**6)
    assert [(r.src_account, r.dst_account, r.n_intermediates, r.n_paths) for r in out.collect()] == [("S", "D", 3, 3)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2


def test_ring_paths_are_numbers(spark, monkeypatch):
    written = []
    cut = GR.cut_lineage
    monkeypatch.setattr(GR, "cut_lineage", lambda df: written.append(df.schema) or cut(df))
    t = edges_df(spark, RING4 + [("X", "A", 0, 12000.0)])
    got = GR.ring_cycles(t.unionByName(t.where("sender_account = 'A'")), 4).collect()
    ids = {r.sender_account: r.tx_id for r in t.collect()}
    assert [(r.tx_ids, r.accounts) for r in got] == [(",".join(ids[a] for a in "ABCD"), "A,B,C,D")] * 2
    paths = [s for s in written if "nodes" in s.names]
    assert len(paths) == 2 and all("string" not in s.simpleString() for s in paths)
