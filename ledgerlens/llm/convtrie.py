"""Prefix trie of conversations as balanced parentheses, one sequence per shard, with shared spines merged.

A conversation is the string of its turns' digests. Sorted strings dealt in ranges put every subtree
that no range boundary crosses into one shard. A shard writes its trie as parentheses in depth-first
order; the excess of open over closed ones, with its least and greatest value per block and per pair of
blocks above, answers findclose: the first place where the excess falls below an open one's. From open
and close follow a subtree's members, its leaves (rank of "()" pairs) and its savings (difference of
cumulative sums over the nodes in order).

Only the nodes on the paths of a shard's first and last conversation, its spine, can also lie in other
shards. Their counts are merged by the digest of their whole prefix; a spine node's own saving and leaf
is owned by one of the paths through it and summed along that path, so each counts once below every
ancestor. A very common conversation fills many shards as one spine, its ids passed on in pieces.

Edge cases: rows without conv_id belong to no conversation; null role and text are empty; a null turn
comes first and equal turns are ordered by digest; repeated rows are turns of their own; conversations
without turns end at the root; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import small_batches, stored

DIGEST = 16                  # bytes of a turn's digest
SHARD_TURNS = 100_000        # turns that one shard's trie holds, one conversation's at least
BLOCK = 64                   # parentheses of one excess block
FAMILY = 100                 # conversations that share an opening, and ...
OPENING = 6                  # ... the number of openings' lengths: fixed values of the query contract

NODE_SCHEMA = ("kind int, shard long, side int, depth long, key binary, conv_id long, parent_conv_id long, n_convs long, "
               "n_children long, n_leaves long, saved_tokens long, chars long, ends string")
LOCAL, BELOW_SPINE, SPINE = 0, 1, 2
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# -- conversations as strings ----------------------------------------------------------------------

def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(" "), role, text).cast("binary"), 256)
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"),
                 F.substring(digest, 1, 2 * DIGEST).alias("digest"), F.length(text).alias("chars")).alias("t"))


def opening_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % F.lit(OPENING)).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path (digests of the rebuilt turns, joined) and chars (code points of each)."""
    own = (_turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
           .select("conv_id", F.transform("t", lambda t: F.struct(t.digest.alias("digest"), t.chars.alias("chars"))).alias("own")))
    own = stored(own, "conversations-own")
    first = own.filter(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("family"), F.slice("own", 1, OPENING - 1).alias("opening"))
    h = opening_length(F.col("conv_id"))
    none = F.slice("own", 1, 0)
    joined = (own.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(first, "family", "left")
              .withColumn("turns", F.concat(F.slice(F.coalesce("opening", none), F.lit(1), h),
                                            F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0))))))
    return joined.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t.digest), "")).alias("path"),
                         F.transform("turns", lambda t: t.chars).alias("chars"))


# -- one shard ------------------------------------------------------------------------------------

class Excess:
    """Excess of a parentheses sequence with a tree of least and greatest values over its blocks."""

    def __init__(self, bits: np.ndarray):
        self.value = np.cumsum(2 * bits.astype(np.int64) - 1)
        n_blocks = 1 << (max(1, -(-len(bits) // BLOCK)) - 1).bit_length()
        padded = np.full(n_blocks * BLOCK, self.value[-1] if len(bits) else 0, np.int64)
        padded[:len(bits)] = self.value
        self.blocks = padded.reshape(n_blocks, BLOCK)
        self.least, self.most = [self.blocks.min(1)], [self.blocks.max(1)]
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(1))
            self.most.append(self.most[-1].reshape(-1, 2).max(1))

    def _in_block(self, block: np.ndarray, after: np.ndarray, below: np.ndarray) -> np.ndarray:
        """First place in each block beyond offset ``after`` with a value under ``below``; -1 if none."""
        out = np.full(len(block), -1, np.int64)
        for a in range(0, len(block), 1 << 15):
            part = slice(a, a + (1 << 15))
            hit = (self.blocks[block[part]] < below[part, None]) & (np.arange(BLOCK)[None, :] > after[part, None])
            found = hit.any(1)
            out[part][found] = block[part][found] * BLOCK + hit[found].argmax(1)
        return out

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Place of the parenthesis that closes each open one."""
        below = self.value[opens]
        block = opens // BLOCK
        out = self._in_block(block, opens % BLOCK, below)
        left = np.flatnonzero(out < 0)
        node, level = block[left], np.zeros(len(left), np.int64)
        below = below[left]
        ready = np.zeros(len(left), bool)
        for up in range(len(self.least) - 1):          # up to the first right neighbour that falls below
            here = ~ready
            even = here & (node % 2 == 0)
            right = np.where(even, node + 1, 0)
            hit = even & (self.least[up][right] < below)
            node = np.where(hit, node + 1, np.where(here, node >> 1, node))
            level = np.where(hit, up, level)
            ready |= hit
        for down in range(len(self.least) - 1, 0, -1):  # and down to its first block that does
            here = level >= down
            child = np.where(here, 2 * node, 0)
            node = np.where(here, np.where(self.least[down - 1][child] < below, child, child + 1), node)
        out[left] = self._in_block(node, np.full(len(node), -1), below)
        return out


def _common(a: bytes, b: bytes) -> int:
    """Leading turns that two paths share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax()) // DIGEST


def _keys(path: bytes, length: int) -> list[bytes]:
    """Digest of each prefix of a path, the empty one first."""
    h = hashlib.sha256()
    out = [h.digest()[:DIGEST]]
    for d in range(length):
        h.update(path[d * DIGEST:(d + 1) * DIGEST])
        out.append(h.digest()[:DIGEST])
    return out


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def shard_nodes(ids: np.ndarray, paths: list[bytes], chars: list[list[int]]) -> pa.RecordBatch:
    """The nodes of the trie of one shard's conversations, sorted by (path, id)."""
    n = len(ids)
    length = np.array([len(p) // DIGEST for p in paths], np.int64)
    common = np.zeros(n, np.int64)
    common[1:] = [_common(a, b) for a, b in zip(paths, paths[1:])]
    opened = length - common
    closed = np.zeros(n + 1, np.int64)
    closed[1:n] = length[:-1] - common[1:]
    closed[n] = length[-1] + 1

    # the root, then for each conversation what it closes and opens
    runs = np.empty(2 * n + 2, np.int64)
    runs[0], runs[1:-1:2], runs[2:-1:2], runs[-1] = 1, closed[:n], opened, closed[n]
    bits = np.repeat(np.arange(len(runs)) % 2 == 0, runs)
    total = int(opened.sum()) + 1
    opens = np.flatnonzero(bits)
    conv = np.concatenate([[0], np.repeat(np.arange(n), opened)])
    first = np.concatenate([[0], np.cumsum(opened)[:-1]]) + 1                # a conversation's first new node
    depth = np.concatenate([[0], np.arange(total - 1) - np.repeat(first - 1, opened) + np.repeat(common, opened) + 1])
    size = np.concatenate([[0], np.array([c for k, cs in zip(common.tolist(), chars) for c in cs[k:]], np.int64)]).astype(np.int64)

    closes = Excess(bits).findclose(opens)
    opened_before = np.cumsum(bits)
    stop = opened_before[closes]                                             # end of the subtree in node order
    pair = np.zeros(len(bits) + 1, np.int64)
    pair[1:] = np.cumsum(bits & ~np.append(bits[1:], True))                  # rank of "()"
    arrived = np.cumsum(runs)[2:-1:2] - 1                                    # where each conversation ends
    low, high = (np.searchsorted(arrived, at) for at in (opens, closes))
    members = high - low
    smallest = np.minimum.reduceat(np.append(ids, np.iinfo(np.int64).max), np.stack([low, high], 1).ravel())[::2]
    order = np.lexsort((np.arange(total), depth))
    place = depth[order] * total + order
    parent = np.full(total, -1, np.int64)
    lower = np.arange(1, total)
    parent[lower] = order[np.searchsorted(place, (depth[lower] - 1) * total + lower) - 1]

    side = np.full(total, -1, np.int64)
    last = opened_before[arrived[-1]] - 1
    right = []
    while last >= 0:
        right.append(int(last))
        last = parent[last]
    side[right] = 1
    left = np.arange(length[0] + 1)
    side[left] = 0
    spine = side >= 0
    children = np.bincount(parent[1:][~spine[1:]], minlength=total)
    leaf = (stop == np.arange(total) + 1) & spine
    lost = np.concatenate([[0], np.cumsum(leaf)])                            # leaves that the merge will count
    leaves = pair[closes + 1] - pair[opens] - (lost[stop] - lost[:-1])
    sums = np.concatenate([[0], np.cumsum(np.where(spine, 0, (members - 1) * size))])
    saved = sums[stop] - sums[:-1]

    # ids that end at a node; equal paths lie together
    ends: list = [None] * total
    begin = np.flatnonzero(np.append(True, arrived[1:] != arrived[:-1]))
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), n]):
        ends[opened_before[arrived[a]] - 1] = _joined(ids[a:b])
    nothing = hashlib.sha256(b"").hexdigest()
    for v in np.flatnonzero(~spine).tolist():
        ends[v] = hashlib.sha256(ends[v].encode()).hexdigest() if ends[v] is not None else nothing

    key: list = [None] * total
    for v, k in zip(left.tolist(), _keys(paths[0], len(left) - 1)):
        key[v] = k
    for v, k in zip(reversed(right), _keys(paths[-1], len(right) - 1)):
        key[v] = k
    above = np.where(parent >= 0, side[parent], -1)
    kind = np.where(spine, SPINE, np.where(above >= 0, BELOW_SPINE, LOCAL))
    rows = np.arange(total)
    rows_side = np.where(spine, side, above)
    # the right path lists the nodes it shares with the left one too, with nothing of its own
    again = np.array([v for v in right if side[v] == 0], np.int64)
    rows = np.concatenate([rows, again])
    fresh = np.append(np.ones(total, bool), np.zeros(len(again), bool))

    def of(x, spare=0):
        return np.where(fresh, x[rows], spare)

    return pa.RecordBatch.from_arrays([
        pa.array(kind[rows], pa.int32()), pa.array(np.full(len(rows), ids[0]), pa.int64()),
        pa.array(np.where(fresh, rows_side[rows], 1), pa.int32()), pa.array(depth[rows], pa.int64()),
        pa.array([key[v] for v in rows.tolist()], pa.binary()), pa.array(smallest[rows], pa.int64()),
        pa.array(smallest[parent[rows]], pa.int64()), pa.array(of(members), pa.int64()), pa.array(of(children), pa.int64()),
        pa.array(of(leaves), pa.int64()), pa.array(of(saved), pa.int64()), pa.array(size[rows], pa.int64()),
        pa.array([ends[v] if f else None for v, f in zip(rows.tolist(), fresh.tolist())], pa.string())],
        names=[c.split()[0] for c in NODE_SCHEMA.split(", ")])


def _shards(shard_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, paths, chars, held = [], [], [], 0
        for b in batches:
            for i, p, c in zip(*(b.column(k).to_pylist() for k in ("conv_id", "path", "chars"))):
                ids.append(i)
                paths.append(p)
                chars.append(c)
                held += len(c) + 1
                if held >= shard_turns:
                    yield shard_nodes(np.array(ids, np.int64), paths, chars)
                    ids, paths, chars, held = [], [], [], 0
        if ids:
            yield shard_nodes(np.array(ids, np.int64), paths, chars)

    return run


# -- spines ---------------------------------------------------------------------------------------

def _end_digests(spine: DataFrame) -> DataFrame:
    """(key, ends_sha256): the hash of all ids that end at a node, over its pieces in order, one at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in batches:
            keys, out = [], []
            for key, ends in zip(b.column("key").to_pylist(), b.column("ends").to_pylist()):
                if key != now:
                    if now is not None:
                        keys.append(now)
                        out.append(h.hexdigest())
                    now, h = key, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())],
                                             names=["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()], pa.string())],
                                             names=["key", "ends_sha256"])

    pieces = (spine.filter("ends is not null").select("key", "ends")
              .withColumn("at", F.substring_index("ends", ",", 1).cast("long")))
    return (pieces.repartition("key").sortWithinPartitions("key", "at").select("key", "ends")
            .mapInArrow(run, "key binary, ends_sha256 string"))


def merged_spines(spine: DataFrame) -> DataFrame:
    """(shard, side, depth, key, owned, ...): the spines' paths, each node with its values over all shards."""
    node = spine.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner_children"),
        F.sum("n_leaves").alias("inner_leaves"), F.sum("saved_tokens").alias("inner_saved"),
        F.min(F.struct("shard", "side")).alias("owner"))
    paths = spine.select("shard", "side", "depth", "key", "chars").join(node, "key")
    down = Window.partitionBy("shard", "side").orderBy("depth")
    paths = (paths.withColumn("owned", F.col("owner") == F.struct("shard", "side"))
             .withColumn("parent_conv_id", F.lag("conv_id").over(down))
             .withColumn("parent_key", F.lag("key").over(down)))
    below = paths.filter("owned and parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(
        F.count(F.lit(1)).alias("spine_children"))
    paths = paths.join(below, "key", "left").withColumn(
        "n_children", F.col("inner_children") + F.coalesce("spine_children", F.lit(0)))
    own = F.col("owned").cast("long")
    up = Window.partitionBy("shard", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    paths = (paths.withColumn("leaf_here", F.sum(own * (F.col("n_children") == 0).cast("long")).over(up))
             .withColumn("saved_here", F.sum(own * (F.col("n_convs") - 1) * F.col("chars")).over(up)))
    along = paths.groupBy("key").agg(F.sum("leaf_here").alias("leaf_sum"), F.sum("saved_here").alias("saved_sum"))
    return paths.join(along, "key").select(
        "shard", "side", "depth", "key", "owned", "conv_id", "parent_conv_id", "n_convs", "n_children",
        (F.col("inner_leaves") + F.col("leaf_sum")).alias("n_leaves"),
        (F.col("inner_saved") + F.col("saved_sum")).alias("saved_tokens"))


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations."""
    spark = conversations.sparkSession
    small_batches(spark)
    paths = stored(rebuilt(conversations), "conversations-rebuilt")
    turns = paths.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))
    nodes = stored(paths.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
                   .mapInArrow(_shards(shard_turns), NODE_SCHEMA), "conversation-nodes")
    spine = nodes.filter(F.col("kind") == SPINE)
    merged = stored(merged_spines(spine), "conversation-spines")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    tops = (merged.filter("owned").join(_end_digests(spine), "key", "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)))
    inner = nodes.filter(F.col("kind") != SPINE).withColumn("ends_sha256", F.col("ends"))
    above = merged.select("shard", "side", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    local = inner.filter(F.col("kind") == LOCAL)
    hanging = (inner.filter(F.col("kind") == BELOW_SPINE).join(above, ["shard", "side", "depth"])
               .withColumn("parent_conv_id", F.col("above")))
    return local.select(*COLUMNS).unionByName(hanging.select(*COLUMNS)).unionByName(tops.select(*COLUMNS))


SQL = f"""
WITH RECURSIVE steps AS (
  SELECT DISTINCT conv_id, 4294967295::BIGINT AS c, 0 AS k FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT conv_id, xor(x >> 1, (x & 1) * 3988292384), k + 1
  FROM (SELECT conv_id, k, CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(conv_id::VARCHAR, k // 8 + 1, 1))::BIGINT) ELSE c END AS x
        FROM steps WHERE k < 8 * length(conv_id::VARCHAR)) s),
lengths AS (
  SELECT conv_id, (xor(c, 4294967295::BIGINT) % {OPENING})::BIGINT AS h FROM steps WHERE k = 8 * length(conv_id::VARCHAR)),
turns AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
         sha256(length(coalesce(role, ''))::VARCHAR || ' ' || coalesce(role, '') || coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({{'t': t, 'n': chars}} ORDER BY turn NULLS FIRST, t) AS own FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.own, [])[1:h], o.own[h + 1:]) AS seq
  FROM own o JOIN lengths l ON l.conv_id = o.conv_id LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {FAMILY}),
prefixes AS (SELECT conv_id, len(seq) AS size, d, seq[1:d] AS p FROM rebuilt, unnest(range(0, len(seq) + 1)) u(d)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d),
children AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.p = n.p),
sums AS (
  SELECT p[1:k] AS p, sum((n_children = 0)::BIGINT) AS n_leaves,
         sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * p[d].n END) AS saved_tokens
  FROM full_nodes, unnest(range(0, d + 1)) u(k) GROUP BY ALL)
SELECT n.conv_id::BIGINT AS conv_id, n.d::BIGINT AS depth, q.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       n.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.p = n.p LEFT JOIN nodes q ON n.d > 0 AND q.p = n.p[1:n.d - 1] AND q.d = n.d - 1
"""
