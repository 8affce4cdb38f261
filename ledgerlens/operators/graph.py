"""The directed account graph as DataFrames (GR-1..18, AGG-5/6/12, JOIN-4..6, SET-1/2).

Vertices are account ids (strings), edges are (src, dst) rows. Every operator is a join /
aggregate plan: hop expansion is a frontier ⨝ edge join with a distinct and an anti-join
against the visited set; path patterns are equi-joins on the shared node (plus a time bucket
where the pattern has a time bound), closed in the join condition so open paths are never
kept. Hot nodes are handled by partial aggregation before each shuffle and by AQE skew-join
splitting of oversized join partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.session import cut_lineage

DAY_US = 86_400 * 1_000_000
MONEY_DEC = "decimal(28,10)"    # sums of amounts are exact to 10 decimals


# --- edges and vertices -----------------------------------------------------------------------

def multi_edges(tx: DataFrame) -> DataFrame:
    """GR-2: one edge per transaction."""
    extra = [c for c in ("tx_id", "ts", "amount_paid", "amount_received", "label", "payment_format") if c in tx.columns]
    return tx.select(F.col("sender_account").alias("src"), F.col("receiver_account").alias("dst"), *extra)


def simple_edges(tx: DataFrame) -> DataFrame:
    """GR-1 / WIN-2: one edge per (src, dst); attributes of the latest transaction (ts, then
    tx_id) win. A partial aggregate with ``max`` over one struct, which carries them once — no per-edge
    sort, no window."""
    latest = F.max(F.struct("ts", "tx_id", "amount_paid", "label", "payment_format", "is_cross_currency"))
    t = tx if "is_cross_currency" in tx.columns else tx.withColumn(
        "is_cross_currency", C.differs("payment_currency", "receiving_currency"))
    e = (t.where(F.col("sender_account").isNotNull() & F.col("receiver_account").isNotNull())
         .groupBy(F.col("sender_account").alias("src"), F.col("receiver_account").alias("dst"))
         .agg(latest.alias("_l"), F.count(F.lit(1)).alias("n_tx")))
    return e.select("src", "dst", "_l.tx_id", "_l.amount_paid", "_l.label", "_l.payment_format",
                    "_l.is_cross_currency", "n_tx")


def accounts(tx: DataFrame) -> DataFrame:
    """AGG-6 / SET-1: distinct union of senders and receivers as ``account_id``."""
    return (tx.select(F.col("sender_account").alias("account_id"))
            .union(tx.select(F.col("receiver_account").alias("account_id")))
            .where(F.col("account_id").isNotNull()).distinct())


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every simple edge, distinct, as (a, b)."""
    e = edges.select("src", "dst")
    return (e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
            .union(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct())


# --- node statistics (AGG-5, GR-3) ----------------------------------------------------------------

# Node feature names and order (must equal the reference's).
NODE_FEATURES = ["log_sent_sum", "sent_count", "log_sent_mean", "log_sent_std", "log_recv_sum", "recv_count",
                 "sent_to_unique", "recv_from_unique"]


def node_stats(tx: DataFrame) -> DataFrame:
    """AGG-5: per account sent sum/count/mean/std, received sum/count, distinct counterparties
    each way; every account present, missing values 0. One aggregation over a long (account,
    role) form instead of four joins; distinct pairs are counted in a second, small pass."""
    sent = tx.select(F.col("sender_account").alias("account_id"), F.col("amount_paid").alias("_sent"),
                     F.lit(None).cast("double").alias("_recv"))
    recv = tx.select(F.col("receiver_account").alias("account_id"), F.lit(None).cast("double").alias("_sent"),
                     F.col("amount_received").alias("_recv"))
    long = sent.unionByName(recv).where(F.col("account_id").isNotNull())
    st = long.groupBy("account_id").agg(
        F.sum(F.col("_sent").cast(MONEY_DEC)).alias("_ss"), F.count("_sent").alias("sent_count"),
        F.stddev_samp("_sent").alias("_sd"),
        F.sum(F.col("_recv").cast(MONEY_DEC)).alias("_rs"), F.count("_recv").alias("recv_count"))
    pairs = tx.where(F.col("sender_account").isNotNull() & F.col("receiver_account").isNotNull()) \
        .select("sender_account", "receiver_account").distinct()
    uniq = (pairs.select(F.col("sender_account").alias("account_id"), F.lit(1).alias("_o"), F.lit(0).alias("_i"))
            .union(pairs.select(F.col("receiver_account").alias("account_id"), F.lit(0), F.lit(1)))
            .groupBy("account_id").agg(F.sum("_o").cast("long").alias("sent_to_unique"),
                                       F.sum("_i").cast("long").alias("recv_from_unique")))
    out = st.join(uniq, "account_id", "left")
    return out.select(
        "account_id",
        C.fixed(F.coalesce(F.col("_ss").cast("double"), F.lit(0.0)), 4).alias("sent_sum"),
        "sent_count",
        C.fixed(F.coalesce(F.try_divide(F.col("_ss").cast("double"), F.col("sent_count").cast("double")), F.lit(0.0)), 6)
        .alias("sent_mean"),
        C.fixed(F.coalesce(F.col("_sd"), F.lit(0.0)), 4).alias("sent_std"),
        C.fixed(F.coalesce(F.col("_rs").cast("double"), F.lit(0.0)), 4).alias("recv_sum"),
        "recv_count",
        F.coalesce("sent_to_unique", F.lit(0).cast("long")).alias("sent_to_unique"),
        F.coalesce("recv_from_unique", F.lit(0).cast("long")).alias("recv_from_unique"))


def node_features(tx: DataFrame, dp: int | None = 6) -> DataFrame:
    """GR-3: the 8 node features (log1p of amounts, raw counts) per account."""
    s = node_stats(tx)
    r = (lambda c: C.fixed(c, dp)) if dp is not None else (lambda c: c)
    return s.select(
        "account_id",
        r(F.log1p("sent_sum")).alias("log_sent_sum"), F.col("sent_count").cast("double").alias("sent_count"),
        r(F.log1p("sent_mean")).alias("log_sent_mean"), r(F.log1p("sent_std")).alias("log_sent_std"),
        r(F.log1p("recv_sum")).alias("log_recv_sum"), F.col("recv_count").cast("double").alias("recv_count"),
        F.col("sent_to_unique").cast("double").alias("sent_to_unique"),
        F.col("recv_from_unique").cast("double").alias("recv_from_unique"))


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """AGG-8: (feature, mean, scale) over all rows, population standard deviation, 1 for a constant
    column; a written table of one row per column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(f"m_{c}", F.lit(0.0)).alias("mean"),
                               F.coalesce(F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(1.0)).alias("scale")) for c in cols])
    return cut_lineage(df.agg(*aggs).select(F.inline(items)))


def standardize(df: DataFrame, cols: list[str], suffix: str = "_z", dp: int | None = None,
                scaler: DataFrame | None = None) -> DataFrame:
    """AGG-9: (x - mean) / scale. ``scaler``: what ``fit_scaler`` returned for the training data, else
    fitted on ``df``. Its rows (one per column) are read once and applied as literals."""
    stats = {r["feature"]: (r["mean"], r["scale"]) for r in (fit_scaler(df, cols) if scaler is None else scaler).collect()}
    out = df
    for c in cols:
        z = (F.col(c) - F.lit(float(stats[c][0]))) / F.lit(float(stats[c][1]))
        out = out.withColumn(c + suffix, C.fixed(z, dp) if dp is not None else z)
    return out


def edge_features(tx_features: DataFrame) -> DataFrame:
    """GR-4: per transaction log1p(paid), cross-currency, format code, cross-bank (missing -> 0)."""
    f = tx_features
    g = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in f.columns else F.lit(0.0)
    return f.select(F.col("sender_account").alias("src"), F.col("receiver_account").alias("dst"), "tx_id", "label",
                    F.coalesce(F.log1p(F.col("amount_paid")), F.lit(0.0)).alias("e_log_amount"),
                    g("is_cross_currency").alias("e_cross_currency"),
                    g("payment_format_enc").alias("e_format"),
                    g("is_cross_bank").alias("e_cross_bank"))


# --- neighbourhood aggregation (GR-10..12) ---------------------------------------------------------

def neighbour_mean(edges: DataFrame, x: DataFrame, cols: list[str], node: str = "account_id",
                   suffix: str = "_nb", exact_dp: int | None = None) -> DataFrame:
    """GR-10: for every node, the mean of its in-neighbours' features over incoming edges,
    counting parallel edges (multiplicity); nodes without in-edges get 0.

    ``exact_dp``: features (already rounded to that many decimals) are summed as scaled
    integers — exact, independent of partitioning, and long arithmetic rather than BigDecimal;
    under ANSI mode an overflow (|x| * 10^dp * in-degree > 9.2e18) raises instead of wrapping."""
    xs = x.select(F.col(node).alias("src"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(cols)])
    msg = edges.select("src", "dst").join(xs, "src")
    if exact_dp is not None:
        sc = float(10 ** exact_dp)
        aggs = [(F.sum(F.round(F.col(f"_x{i}") * F.lit(sc)).cast("long")).cast("double") / F.lit(sc)).alias(f"_s{i}")
                for i in range(len(cols))]
    else:
        aggs = [F.sum(F.col(f"_x{i}")).alias(f"_s{i}") for i in range(len(cols))]
    agg = msg.groupBy("dst").agg(F.count(F.lit(1)).alias("_deg"), *aggs)
    j = x.select(node).join(agg, F.col(node) == F.col("dst"), "left")
    return j.select(node, *[F.coalesce(F.col(f"_s{i}") / F.greatest(F.col("_deg"), F.lit(1)).cast("double"),
                                       F.lit(0.0)).alias(c + suffix) for i, c in enumerate(cols)])


def khop_embedding(edges: DataFrame, x: DataFrame, cols: list[str], k: int = 2, node: str = "account_id",
                   dp: int | None = None, checkpoint: bool = True) -> DataFrame:
    """GR-11: [x, A x, A^2 x, ...] with A = mean over in-edges (pre-computed propagation, the
    published SIGN/SGC form; a linear head is trained on it). Output: node + k+1 blocks.

    Each layer reads the previous one; with ``checkpoint`` every layer (one row per node) is a
    reliable checkpoint, so layer h does not recompute layers 0..h-1. The edge list is read
    once per layer, joined on its source and aggregated on its destination (partial sums
    map-side, so a hub destination costs one row per map task)."""
    r = (lambda c: C.fixed(c, dp)) if dp is not None else (lambda c: c)
    cur = x.select(node, *[r(F.col(c)).alias(c) for c in cols])
    if checkpoint:
        cur = cut_lineage(cur)
    out = cur.select(node, *[F.col(c).alias(f"{c}_h0") for c in cols])
    msg_edges = edges.select("src", "dst")
    for h in range(1, k + 1):
        nb = neighbour_mean(msg_edges, cur, cols, node, suffix="", exact_dp=dp)
        nb = nb.select(node, *[r(F.col(c)).alias(c) for c in cols])
        if checkpoint:
            nb = cut_lineage(nb)
        out = out.join(nb.select(node, *[F.col(c).alias(f"{c}_h{h}") for c in cols]), node)
        cur = nb
    return out


def edge_representation(edge_feats: DataFrame, emb: DataFrame, node: str = "account_id") -> DataFrame:
    """GR-12: per edge, source embedding ‖ destination embedding ‖ edge features (two joins)."""
    ecols = [c for c in emb.columns if c != node]
    s = emb.select(F.col(node).alias("src"), *[F.col(c).alias(f"src_{c}") for c in ecols])
    d = emb.select(F.col(node).alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in ecols])
    return edge_feats.join(s, "src", "left").join(d, "dst", "left")


def label_fraud_nodes(tx: DataFrame) -> DataFrame:
    """GR-13: 1 for accounts on either end of a fraudulent transaction, else 0."""
    ends = (tx.select(F.col("sender_account").alias("account_id"), "label")
            .union(tx.select(F.col("receiver_account").alias("account_id"), "label"))
            .where(F.col("account_id").isNotNull()))
    return ends.groupBy("account_id").agg(F.max(F.coalesce(F.col("label"), F.lit(0))).cast("int").alias("is_fraud_node"))


def edge_score(tx: DataFrame, node_scores: DataFrame, score: str = "score", node: str = "account_id") -> DataFrame:
    """JOIN-5: node score gathered to both ends of each transaction and averaged."""
    s = node_scores.select(F.col(node).alias("sender_account"), F.col(score).alias("_ss"))
    d = node_scores.select(F.col(node).alias("receiver_account"), F.col(score).alias("_ds"))
    j = tx.join(s, "sender_account", "left").join(d, "receiver_account", "left")
    return j.withColumn("edge_score", (F.col("_ss") + F.col("_ds")) / F.lit(2.0)).drop("_ss", "_ds")


# --- ego subgraphs (GR-5..9, SET-2, JOIN-6) --------------------------------------------------------

def ego_nodes(edges: DataFrame, seeds: DataFrame, hops: int = 2, seed_col: str = "seed",
              checkpoint: bool = True) -> DataFrame:
    """GR-5 node sets: (seed, node, hop) for every node within ``hops`` undirected steps of
    each seed. Seeds absent from the graph yield nothing. Each hop joins the new frontier
    with the undirected edges, takes distinct (seed, node) and anti-joins the visited set
    (SET-2). With ``checkpoint`` the undirected edge set (read by every hop) and the visited
    set after every hop are reliable checkpoints, so the plan does not grow with the hops and
    a lost executor recomputes one hop, not the whole expansion."""
    und = undirected(edges)
    if checkpoint:
        und = cut_lineage(und)
    verts = und.select(F.col("a").alias("node")).distinct()
    visited = (seeds.select(F.col(seed_col).alias("seed")).distinct()
               .join(verts, F.col("seed") == F.col("node"), "left_semi")
               .select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")))
    frontier = visited
    for h in range(1, hops + 1):
        nxt = (frontier.join(und, frontier["node"] == und["a"]).select("seed", F.col("b").alias("node")).distinct()
               .join(visited.select("seed", "node"), ["seed", "node"], "left_anti")
               .withColumn("hop", F.lit(h)))
        visited = visited.unionByName(nxt)
        if checkpoint:
            visited = cut_lineage(visited)
            frontier = visited.where(F.col("hop") == h)
        else:
            frontier = nxt
    return visited


LIST_MEMBERS = 4096     # node sets that one node's list names; hubs in more are taken row by row


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of ``edges`` with both ends inside the same seed's node set: (seed, src, dst, ...).

    A node's seeds travel as one list, from the end of an edge that lies in fewer node sets to the other
    end, where the two lists are intersected; only shared seeds become rows. A node in more than
    LIST_MEMBERS sets has no list: the other end's seeds are looked up among its sets one by one."""
    n = nodes.select("seed", "node")
    sets = cut_lineage(n.groupBy("node").agg(F.count(F.lit(1)).alias("_sets")))
    hubs = F.col("_sets") > LIST_MEMBERS
    short = n.join(sets.where(hubs), "node", "left_anti")
    lists = cut_lineage(short.groupBy("node").agg(F.collect_set("seed").alias("_seeds")))
    e = (edges.join(sets.select(F.col("node").alias("src"), F.col("_sets").alias("_ns")), "src")
         .join(sets.select(F.col("node").alias("dst"), F.col("_sets").alias("_nd")), "dst"))
    many = sets.where(hubs).limit(1).count() > 0
    out = None
    for near, far, a, b, fewer in (("src", "dst", "_ns", "_nd", F.col("_ns") <= F.col("_nd")),
                                   ("dst", "src", "_nd", "_ns", F.col("_ns") > F.col("_nd"))):
        own = lists.select(F.col("node").alias(near), F.col("_seeds").alias("_near"))
        other = lists.select(F.col("node").alias(far), F.col("_seeds").alias("_far"))
        parts = [e.where(fewer & (F.col(b) <= LIST_MEMBERS)).join(own, near).join(other, far)
                 .select(F.explode(F.array_intersect("_near", "_far")).alias("seed"), *edges.columns)]
        if many:
            to_hub = e.where(fewer & (F.col(b) > LIST_MEMBERS))
            parts.append(to_hub.join(n.withColumnRenamed("node", near), near)
                         .join(n.withColumnRenamed("node", far), ["seed", far], "left_semi").select("seed", *edges.columns))
        for j in parts:
            out = j if out is None else out.unionByName(j)
    return out


def ego_subgraph(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """GR-5: (nodes, edges) of the induced directed subgraph around each seed."""
    nodes = ego_nodes(edges, seeds, hops)
    return nodes, induced_edges(edges, nodes)


def subgraph_degrees(sub_edges: DataFrame, fraud: str = "label") -> DataFrame:
    """GR-7: per (seed, node) out-degree, in-degree and fraud-labelled out-degree."""
    out = sub_edges.select("seed", F.col("src").alias("node"), F.lit(1).alias("_o"), F.lit(0).alias("_i"),
                           F.coalesce(F.col(fraud), F.lit(0)).alias("_f"))
    inn = sub_edges.select("seed", F.col("dst").alias("node"), F.lit(0).alias("_o"), F.lit(1).alias("_i"),
                           F.lit(0).alias("_f"))
    return out.unionByName(inn).groupBy("seed", "node").agg(
        F.sum("_o").cast("long").alias("out_degree"), F.sum("_i").cast("long").alias("in_degree"),
        F.sum("_f").cast("long").alias("fraud_out"))


def node_roles(nodes: DataFrame, sub_edges: DataFrame, flagged: DataFrame, flag_col: str = "account_id") -> DataFrame:
    """GR-8 (+JOIN-6): role per (seed, node): seed > flagged > fraud_linked (fraud out-edge) > normal."""
    deg = subgraph_degrees(sub_edges)
    fl = flagged.select(F.col(flag_col).alias("node")).distinct().withColumn("_flag", F.lit(True))
    j = (nodes.select("seed", "node").join(deg, ["seed", "node"], "left").join(fl, "node", "left"))
    role = (F.when(F.col("node") == F.col("seed"), "seed")
            .when(F.col("_flag"), "flagged")
            .when(F.coalesce(F.col("fraud_out"), F.lit(0)) > 0, "fraud_linked")
            .otherwise("normal"))
    return j.select("seed", "node", role.alias("role"),
                    *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("out_degree", "in_degree", "fraud_out")])


def graph_summary(edges: DataFrame, fraud: str = "label", by: list[str] | None = None) -> DataFrame:
    """AGG-12: nodes, edges, fraud edges and fraud share (%) of a graph (or per ``by`` group)."""
    by = by or []
    ends = edges.select(*by, F.col("src").alias("n")).union(edges.select(*by, F.col("dst").alias("n")))
    nodes = ends.groupBy(*by).agg(F.count_distinct("n").alias("n_nodes")) if by else \
        ends.agg(F.count_distinct("n").alias("n_nodes"))
    e = edges.groupBy(*by) if by else edges
    es = e.agg(F.count(F.lit(1)).alias("n_edges"),
               F.count_if(F.coalesce(F.col(fraud), F.lit(0)) == 1).alias("n_fraud_edges"))
    es = es.withColumn("fraud_pct", C.fixed(F.try_divide(F.col("n_fraud_edges") * F.lit(100.0), F.col("n_edges")), 6))
    return nodes.join(es, by, "full") if by else _one_row_join(nodes, es)


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Attach the single row of ``b`` to every row of ``a``: ``b`` is one row (a fixed bound), so it
    is broadcast and ``a`` is never shuffled on the constant key."""
    return a.withColumn("_k", F.lit(1)).join(F.broadcast(b.withColumn("_k", F.lit(1))), "_k").drop("_k")


def alert_neighbourhood(edges: DataFrame, alerts: DataFrame, alert_id: str = "tx_id",
                        checkpoint: bool = True) -> tuple[DataFrame, DataFrame]:
    """GR-6 + GR-9: for each alert (sender -> receiver), the nodes {sender, receiver} and their
    in/out neighbours, the induced edges, and ``highlight`` = alert edge or fraud edge. The
    alert list and node sets are checkpointed (each is read several times)."""
    alerts = alerts.select(alert_id, "sender_account", "receiver_account")
    if checkpoint:
        alerts = cut_lineage(alerts)
    ends = (alerts.select(F.col(alert_id).alias("seed"), F.col("sender_account").alias("node"))
            .union(alerts.select(F.col(alert_id).alias("seed"), F.col("receiver_account").alias("node"))).distinct())
    if checkpoint:
        ends = cut_lineage(ends)
    # an end is in the graph where it has an edge, so both nodes of each edge at an end are all there are
    met = None
    for near, far in (("src", "dst"), ("dst", "src")):
        m = edges.select(F.col(near).alias("node"), F.col(far).alias("_to")).join(ends, "node")
        met = m if met is None else met.unionByName(m)
    nodes = met.select("seed", F.explode(F.array("node", "_to")).alias("node")).distinct()
    if checkpoint:
        nodes = cut_lineage(nodes)
    sub = induced_edges(edges, nodes)
    a = alerts.select(F.col(alert_id).alias("seed"), F.col("sender_account").alias("_as"),
                      F.col("receiver_account").alias("_ar"))
    sub = sub.join(a, "seed").withColumn(
        "highlight", (((F.col("src") == F.col("_as")) & (F.col("dst") == F.col("_ar")))
                      | (F.coalesce(F.col("label"), F.lit(0)) == 1)).cast("int")).drop("_as", "_ar")
    return nodes, sub


# --- pattern detectors (GR-14..18) ---------------------------------------------------------------

def through_accounts(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(n): the accounts that both send and receive, as a written table: its size is known to the planner
    before it is joined, so that edges are moved for it only where it is large."""
    return cut_lineage(edges.select(F.col(src).alias("n")).distinct()
                       .join(edges.select(F.col(dst).alias("n")).distinct(), "n", "left_semi"))


def trimmed_edges(edges: DataFrame) -> DataFrame:
    """Simple edges without self-loops whose two ends both send and receive (a node on a cycle
    always does, so no cycle is lost)."""
    e = edges.select("src", "dst").where(F.col("src") != F.col("dst"))
    both = through_accounts(e)
    return (e.join(both.withColumnRenamed("n", "src"), "src", "left_semi")
             .join(both.withColumnRenamed("n", "dst"), "dst", "left_semi").distinct())


def cycles_3(edges: DataFrame, checkpoint: bool = True) -> DataFrame:
    """GR-14: directed 3-cycles a -> b -> c -> a, each listed once from its smallest id.

    Every cycle u -> v -> w -> u is found exactly once, at its lowest-ranked vertex u
    (rank = (degree, id)): the wedge pairs u's higher-ranked out-neighbours v with its
    higher-ranked in-neighbours w, and the closing edge v -> w is part of the join key, so open
    paths are never kept. A hub has the highest rank, so its neighbour pairs are never formed;
    the wedge count is bounded by O(m^1.5) rather than the hub's in-degree x out-degree. The
    cycle is then rotated to start at its smallest id. The trimmed edge set is read four times
    and is written once (``checkpoint``)."""
    e = trimmed_edges(edges).select("src", "dst")
    if checkpoint:
        e = cut_lineage(e)
    deg = (e.select(F.col("src").alias("n")).union(e.select(F.col("dst").alias("n")))
           .groupBy("n").agg(F.count(F.lit(1)).alias("d")))
    r = (e.join(deg.select(F.col("n").alias("src"), F.col("d").alias("ds")), "src")
         .join(deg.select(F.col("n").alias("dst"), F.col("d").alias("dd")), "dst"))
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    out_hi = r.where(up).select(F.col("src").alias("u"), F.col("dst").alias("v"))         # rank(v) > rank(u)
    in_hi = r.where(~up).select(F.col("dst").alias("u"), F.col("src").alias("w"))         # rank(w) > rank(u)
    closing = e.select(F.col("src").alias("v"), F.col("dst").alias("w"))
    cyc = out_hi.join(in_hi, "u").where(F.col("v") != F.col("w")).join(closing, ["v", "w"])
    m = F.least("u", "v", "w")
    a = m
    b = F.when(F.col("u") == m, F.col("v")).when(F.col("v") == m, F.col("w")).otherwise(F.col("u"))
    c = F.when(F.col("u") == m, F.col("w")).when(F.col("v") == m, F.col("u")).otherwise(F.col("v"))
    return cyc.select(a.alias("node_a"), b.alias("node_b"), c.alias("node_c"))


def cycle_membership(edges: DataFrame, candidates: DataFrame, max_len: int = 4) -> DataFrame:
    """GR-14 (scoring form): whether each candidate transfer (cand_id, src, dst) would close a directed
    cycle of at most ``max_len`` edges, and its length; see ``bitgraph.cycle_lengths``."""
    from ledgerlens.operators.bitgraph import cycle_lengths
    return cycle_lengths(edges, candidates, max_len)


def _windowed_counterparties(tx: DataFrame, key: str, other: str, window: str, amount: str) -> DataFrame:
    """Distinct counterparties per (account, tumbling window) in two exchanges: (account, window,
    counterparty) first — a hot account's pairs spread over many tasks — then per window."""
    w = F.window("ts", window)
    pairs = (tx.where(F.col(key).isNotNull() & F.col(other).isNotNull() & F.col("ts").isNotNull())
             .groupBy(F.col(key).alias("account_id"), w.start.alias("window_start"), F.col(other).alias("_o"))
             .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(amount).cast(MONEY_DEC)).alias("_s")))
    return pairs.groupBy("account_id", "window_start").agg(
        F.count(F.lit(1)).alias("n_counterparties"), F.sum("_n").cast("long").alias("n_tx"),
        C.fixed(F.sum("_s").cast("double"), 4).alias("total_amount"))


def fan_out(tx: DataFrame, window: str = "30 days", min_receivers: int = 5) -> DataFrame:
    """GR-15: senders paying at least ``min_receivers`` distinct receivers in one window."""
    r = _windowed_counterparties(tx, "sender_account", "receiver_account", window, "amount_paid")
    return r.where(F.col("n_counterparties") >= min_receivers)


def fan_in(tx: DataFrame, window: str = "30 days", min_senders: int = 5) -> DataFrame:
    """GR-16: receivers paid by at least ``min_senders`` distinct senders in one window."""
    r = _windowed_counterparties(tx, "receiver_account", "sender_account", window, "amount_received")
    return r.where(F.col("n_counterparties") >= min_senders)


# Width of a time or amount bucket, in spans (widest gap, widest ratio): wider ones copy fewer legs into two
# buckets and let more legs meet.
BUCKET_SPANS = 2


def _leg_keys(legs: DataFrame, max_gap_us: int, min_ratio: float, max_ratio: float) -> tuple[DataFrame, DataFrame]:
    """Range join of consecutive legs as an equi-join: ``legs`` (t microseconds, a amount) keyed as a
    first leg (one time and one amount bucket) and as a following leg (one or two of each).

    A following leg is due within ``max_gap_us`` of the first and carries min_ratio..max_ratio of its
    amount, so the first leg lies between two bounds, by time and by log amount; buckets are BUCKET_SPANS
    times as wide as these are apart, so they mostly fall in one. Zero amounts,
    which only zero follows, have a bucket of their own; a ratio without a lower bound has no amount
    bucket. Every qualifying pair meets exactly once."""
    wide = F.lit(max_gap_us * BUCKET_SPANS)
    tb = F.floor(F.col("t") / wide)
    before = F.floor((F.col("t") - F.lit(max_gap_us)) / wide)
    if min_ratio > 0:
        eps = 1e-6     # widens the buckets beyond rounding of the logarithm
        span = math.log(max_ratio / min_ratio) + 4 * eps
        at = lambda y: F.floor(y / F.lit(span * BUCKET_SPANS)).cast("long")
        zero = F.when(F.col("a") == 0, F.lit(-10**9).cast("long"))
        first_ab = F.when(F.col("a") > 0, at(F.log("a") + F.lit(math.log(min_ratio) - 2 * eps))).otherwise(zero)
        high, low = at(F.log("a")), at(F.log("a") - F.lit(span))
        next_ab = F.when(F.col("a") == 0, F.array(zero)).otherwise(F.array_distinct(F.array(high, low)))
    else:
        first_ab, next_ab = F.lit(0).cast("long"), F.array(F.lit(0).cast("long"))
    first = legs.withColumn("tb", tb).withColumn("ab", first_ab)
    after = (legs.withColumn("tb", F.explode(F.array_distinct(F.array(tb, before))))
             .withColumn("ab", F.explode(next_ab)))
    return first, after


def _follows(t1: str, a1: str, t2: str, a2: str, max_gap_us: int, min_ratio: float, max_ratio: float) -> Column:
    gap = F.col(t2) - F.col(t1)
    return ((gap >= 0) & (gap <= F.lit(max_gap_us)) & (F.col(a2) >= F.col(a1) * F.lit(min_ratio))
            & (F.col(a2) <= F.col(a1) * F.lit(max_ratio)))


def split_merge(tx: DataFrame, max_gap_us: int = 30 * DAY_US, min_ratio: float = 0.9, max_ratio: float = 1.0,
                min_intermediates: int = 2) -> DataFrame:
    """GR-17: src -> m -> dst legs where the second leg leaves m no earlier than the first
    arrives and within ``max_gap_us``, carrying min_ratio..max_ratio of the first amount; pairs
    (src, dst), src != dst, reached through at least ``min_intermediates`` distinct m.

    An equi-join on (m, time bucket, amount bucket), so a hub m is split by time and amount
    instead of pairing all its in- and out-legs."""
    base = tx.where(F.col("sender_account").isNotNull() & F.col("receiver_account").isNotNull()
                    & (F.col("sender_account") != F.col("receiver_account")) & F.col("ts").isNotNull()
                    & (F.col("amount_paid") >= 0))
    legs = base.select("sender_account", "receiver_account", F.unix_micros("ts").alias("t"),
                       F.col("amount_paid").alias("a"))
    mids = through_accounts(legs, "sender_account", "receiver_account")     # all that an m can be
    first = _leg_keys(legs.join(mids.withColumnRenamed("n", "receiver_account"), "receiver_account", "left_semi"),
                      max_gap_us, min_ratio, max_ratio)[0]
    after = _leg_keys(legs.join(mids.withColumnRenamed("n", "sender_account"), "sender_account", "left_semi"),
                      max_gap_us, min_ratio, max_ratio)[1]
    leg1 = first.select(F.col("sender_account").alias("src"), F.col("receiver_account").alias("m"), "tb", "ab",
                        F.col("t").alias("t1"), F.col("a").alias("a1"))
    leg2 = after.select(F.col("sender_account").alias("m"), F.col("receiver_account").alias("dst"), "tb", "ab",
                        F.col("t").alias("t2"), F.col("a").alias("a2"))
    p = leg1.join(leg2, ["m", "tb", "ab"]).where(
        _follows("t1", "a1", "t2", "a2", max_gap_us, min_ratio, max_ratio) & (F.col("src") != F.col("dst")))
    per_mid = p.groupBy("src", "dst", "m").agg(F.count(F.lit(1)).alias("_n"))
    out = per_mid.groupBy(F.col("src").alias("src_account"), F.col("dst").alias("dst_account")).agg(
        F.count(F.lit(1)).alias("n_intermediates"), F.sum("_n").cast("long").alias("n_paths"))
    return out.where(F.col("n_intermediates") >= min_intermediates)


def ring_cycles(tx: DataFrame, length: int = 5, max_gap_us: int = 30 * DAY_US, min_ratio: float = 0.9,
                max_ratio: float = 1.0) -> DataFrame:
    """GR-14 (laundering rings): directed cycles of ``length`` transfers through as many different
    accounts, strictly forward in time, each transfer within ``max_gap_us`` of the one before and
    carrying min_ratio..max_ratio of its amount. One row per ring of transfers, found at its earliest
    one: (tx_ids, accounts), both in order.

    Only transfers between accounts that both send and receive can lie on a ring. A path grows by an
    equi-join on (account, time bucket, amount bucket), so a hub's transfers meet only those that can
    follow; the last transfer has the start in its join key, so open paths of full length are never
    kept. Accounts and transfers are numbers on the way, so that long ids are moved for closed rings only.
    Paths are written after each hop."""
    if length < 2:
        raise ValueError("a ring has at least two transfers")
    base = tx.where((F.col("sender_account") != F.col("receiver_account")) & F.col("ts").isNotNull()
                    & (F.col("amount_paid") >= 0))
    both = through_accounts(base, "sender_account", "receiver_account")
    number = cut_lineage(ordered_index(both, "n"))
    legs = cut_lineage(
        base.join(number.select(F.col("n").alias("sender_account"), F.col("idx").alias("s")), "sender_account")
        .join(number.select(F.col("n").alias("receiver_account"), F.col("idx").alias("r")), "receiver_account")
        .select(F.monotonically_increasing_id().alias("leg"), "tx_id", "sender_account", "s", "r",
                F.unix_micros("ts").alias("t"), F.col("amount_paid").alias("a")))
    _, after = _leg_keys(legs, max_gap_us, min_ratio, max_ratio)
    nxt = after.select(F.col("s").alias("end"), "tb", "ab", F.col("leg").alias("_id"), F.col("r").alias("_r"),
                       F.col("t").alias("_t"), F.col("a").alias("_a"))
    paths = legs.select(F.col("s").alias("start"), F.col("r").alias("end"), "t", "a",
                        F.array("leg").alias("ids"), F.array("s", "r").alias("nodes"))
    fits = _follows("t", "a", "_t", "_a", max_gap_us, min_ratio, max_ratio) & (F.col("_t") > F.col("t"))
    for _ in range(length - 2):
        p, _unused = _leg_keys(paths, max_gap_us, min_ratio, max_ratio)
        grown = p.join(nxt, ["end", "tb", "ab"]).where(fits & ~F.array_contains("nodes", F.col("_r")))
        paths = cut_lineage(grown.select("start", F.col("_r").alias("end"), F.col("_t").alias("t"), F.col("_a").alias("a"),
                                         F.array_append("ids", F.col("_id")).alias("ids"),
                                         F.array_append("nodes", F.col("_r")).alias("nodes")))
    p, _unused = _leg_keys(paths, max_gap_us, min_ratio, max_ratio)
    closing = nxt.withColumnRenamed("_r", "start")
    rings = cut_lineage(p.join(closing, ["end", "tb", "ab", "start"]).where(fits)
                        .select(F.array_append("ids", F.col("_id")).alias("ids")))
    named = (rings.select("ids", F.posexplode("ids").alias("_i", "leg")).join(legs.select("leg", "tx_id", "sender_account"), "leg")
             .groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("_i", "tx_id", "sender_account"))).alias("_l")))
    return named.select(F.array_join("_l.tx_id", ",").alias("tx_ids"), F.array_join("_l.sender_account", ",").alias("accounts"))


# Fixed value: reporting limit for cash structuring (must equal the reference's sample).
REPORTING_LIMIT = 10000.0


def structuring(tx: DataFrame, limit: float = REPORTING_LIMIT, band: float = 0.1, min_n: int = 2,
                window: str = "90 days", amount: str = "amount_received") -> DataFrame:
    """GR-18: senders with at least ``min_n`` transfers in [limit*(1-band), limit) in one window."""
    lo = limit * (1.0 - band)
    f = tx.where((F.col(amount) >= F.lit(lo)) & (F.col(amount) < F.lit(limit)) & F.col("sender_account").isNotNull())
    g = f.groupBy(F.col("sender_account").alias("account_id"), F.window("ts", window).start.alias("window_start")).agg(
        F.count(F.lit(1)).alias("n_tx"), C.fixed(F.sum(F.col(amount).cast(MONEY_DEC)).cast("double"), 4)
        .alias("total_amount"))
    return g.where(F.col("n_tx") >= min_n)


def top_accounts_by(tx: DataFrame, flag: Column, k: int, role: str = "sender_account") -> DataFrame:
    """Top-k report: the ``k`` accounts with most flagged transfers (ties by id), as ``seed``."""
    c = tx.where(flag).groupBy(F.col(role).alias("seed")).agg(F.count(F.lit(1)).alias("_n"))
    return c.orderBy(F.col("_n").desc(), F.col("seed")).limit(k).select("seed")


# --- account index and attribute joins (AGG-6 index, JOIN-3, JOIN-4) ------------------------------

def ordered_index(values: DataFrame, col: str, out: str = "idx", partitions: int | None = None) -> DataFrame:
    """Dense 0-based index of the distinct values of ``col`` in sort order (the id order replaces
    the reference's first-seen order, which Spark does not have).

    No single-partition window: the distinct values are range-partitioned and sorted, numbered
    inside each partition by a running counter over its Arrow batches, and shifted by the row
    counts of the earlier partitions (a table of one row per partition). The numbered set is
    checkpointed so both uses see the same partitioning."""
    import numpy as np

    spark = values.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dtype = values.schema[col].dataType.simpleString()
    d = values.select(F.col(col).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    r = d.repartitionByRange(n, "_v").sortWithinPartitions("_v").withColumn("_p", F.spark_partition_id())

    def number(batches):
        k = 0
        for pdf in batches:
            pdf["_l"] = np.arange(k, k + len(pdf), dtype="int64")
            k += len(pdf)
            yield pdf

    loc = cut_lineage(r.mapInPandas(number, f"_v {dtype}, _p int, _l long"))
    counts = loc.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    off = counts.select("_p", F.coalesce(F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_p")
                                                          .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                        .alias("_o"))
    return loc.join(F.broadcast(off), "_p").select(F.col("_v").alias(col), (F.col("_o") + F.col("_l")).alias(out))


def index_edges(edges: DataFrame, index: DataFrame, node: str = "account_id", idx: str = "idx") -> DataFrame:
    """JOIN-4: both edge ends replaced by their index (two joins with the index table)."""
    s = index.select(F.col(node).alias("src"), F.col(idx).alias("src_idx"))
    d = index.select(F.col(node).alias("dst"), F.col(idx).alias("dst_idx"))
    return edges.join(s, "src").join(d, "dst")


def join_account_attributes(tx: DataFrame, attrs: DataFrame, node: str = "account_id") -> DataFrame:
    """JOIN-3: inner join of each transaction with the attributes of its source and of its target
    account; attribute columns are prefixed ``src_`` / ``dst_``."""
    cols = [c for c in attrs.columns if c != node]
    s = attrs.select(F.col(node).alias("sender_account"), *[F.col(c).alias(f"src_{c}") for c in cols])
    d = attrs.select(F.col(node).alias("receiver_account"), *[F.col(c).alias(f"dst_{c}") for c in cols])
    return tx.join(s, "sender_account").join(d, "receiver_account")
