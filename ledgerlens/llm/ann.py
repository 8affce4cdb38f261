"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, normalised and rotated at random; a code keeps one sign bit per dimension, beside
the vector's distance from the centre and its alignment with its own code. For a query, popcounts of
the code with the query's 4-bit planes estimate the inner product; dividing by the alignment corrects
it, and the known error law bounds it. Vectors whose lower distance bound exceeds the tenth best upper
or exact distance so far are skipped, the others are reranked on the original vectors, in double
precision.

Every vector is coded and every query sees every code: rows are packed in blocks of BLOCK vectors,
queries in blocks of QUERY_BLOCK, and each pair of a query block and a share of the row blocks is one
task group, which returns each query's ten best. So no group grows with a common vector, and memory is
bounded by the block sizes. The rotation is seeded and the centre is the mean of all rows.

Edge cases: null vectors, zero vectors and those with null or non-finite components take no part;
vectors meet only those of their own dimension; a null vec_id takes no part; equal distances go to the
smaller vec_id; repeated rows are candidates each, rows of the query's own vec_id are not; repeated
query rows are one query, and a vec_id with several vectors is a query, with ranks from 1, for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored

NEIGHBOURS = 10
BLOCK = 1024
QUERY_BLOCK = 2048
BLOCKS_PER_GROUP = 4       # at least this many row blocks in a group, MAX_GROUP_BLOCKS at most
MAX_GROUP_BLOCKS = 256
MAX_DIMENSION = 8192       # bounds the rotation, which every task makes for itself
EPSILON = 1.9              # width of the error bound, in standard deviations of the rotation
SEED = 7
BLOCK_SCHEMA = "block long, ids binary, vectors binary, codes binary, norms binary, alignment binary"


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v array<double>, dim of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return (embeddings.filter("vec_id is not null and embedding is not null")
            .select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.size("v") > 0).filter(fine)
            .withColumn("dim", F.size("v")))


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    if dim > MAX_DIMENSION:
        raise ValueError(f"dimension over {MAX_DIMENSION}")
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    n, d = bits.shape
    wide = np.zeros((n, -(-d // 64) * 64), np.uint8)
    wide[:, :d] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, distance from the centre, alignment of the unit vector with its code)."""
    rest = x - centre
    norm = np.linalg.norm(rest, axis=1)
    unit = (rest / np.where(norm > 0, norm, 1)[:, None]) @ turn
    align = np.abs(unit).sum(1) / np.sqrt(x.shape[1])
    return _pack(unit > 0), norm, np.where(norm > 0, align, 1.0)


def estimate(q: np.ndarray, codes: np.ndarray, norm: np.ndarray, align: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, its error bound) of each rotated, centred query to each code."""
    low, high = q.min(1), q.max(1)
    step = np.where(high > low, (high - low) / 15, 1.0)
    level = np.rint((q - low[:, None]) / step[:, None]).astype(np.uint8)
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    inner = np.zeros((len(q), len(codes)))
    for j in range(4):
        plane = _pack(level >> j & 1)
        hits = np.zeros((len(q), len(codes)), np.uint32)
        for w in range(codes.shape[1]):
            hits += np.bitwise_count(plane[:, w, None] & codes[None, :, w])
        inner += (1 << j) * hits
    root = np.sqrt(dim)
    inner = (2 * (step[:, None] * inner + low[:, None] * ones[None, :]) - q.sum(1)[:, None]) / root
    size = np.linalg.norm(q, axis=1)
    squared = norm[None, :] ** 2 + size[:, None] ** 2 - 2 * (norm / align)[None, :] * inner
    spread = np.sqrt(np.maximum(0, 1 - align**2)) / align / np.sqrt(max(1, dim - 1))
    rounding = step / np.sqrt(3)                              # of the query's 4-bit levels
    return squared, 2 * EPSILON * norm[None, :] * (size[:, None] * spread[None, :] + rounding[:, None] / align[None, :])


def blocks(rows: DataFrame, centre: np.ndarray, dim: int) -> DataFrame:
    """Blocks of at most BLOCK coded vectors."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        for b in batches:
            ids = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy().reshape(-1, dim)
            for a in range(0, len(ids), BLOCK):
                part = x[a:a + BLOCK]
                codes, norm, align = encode(part, centre, turn)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0], pa.int64()), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in (
                        ids[a:a + BLOCK].astype("<i8"), part.astype("<f8"), codes, norm, align))],
                    names=["block", "ids", "vectors", "codes", "norms", "alignment"])

    return rows.select("vec_id", "v").mapInArrow(make, BLOCK_SCHEMA).drop("block")


def _best(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, dist))[:k]


def search_group(query_ids: np.ndarray, keys: np.ndarray, queries: np.ndarray, parts: list[tuple], centre: np.ndarray, k: int) -> list[tuple]:
    """(query_id, key, vec_id, score) of the k nearest of each query among the blocks."""
    dim = queries.shape[1]
    turned = (queries - centre) @ rotation(dim)
    far = np.full(len(queries), np.inf)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(queries)
    for ids, x, codes, norm, align in parts:
        for a in range(0, len(queries), 128):
            squared, error = estimate(turned[a:a + 128], codes, norm, align, dim)
            other = ids[None, :] != query_ids[a:a + 128, None]
            upper = np.where(other, squared + error, np.inf)
            limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(ids) >= k else np.full(len(upper), np.inf)
            limit = np.minimum(limit, far[a:a + 128] ** 2)
            near = other & (squared - error <= limit[:, None])
            for r in range(len(near)):
                c = np.flatnonzero(near[r])
                if not len(c):
                    continue
                q = a + r
                d = np.concatenate((best[q][0], np.sqrt(((x[c] - queries[q]) ** 2).sum(1))))
                i = np.concatenate((best[q][1], ids[c]))
                top = _best(d, i, k)
                best[q] = d[top], i[top]
                if len(top) == k:
                    far[q] = d[top[-1]]
    return [(q, key, i, d) for q, key, (ds, js) in zip(query_ids.tolist(), keys.tolist(), best) for d, i in zip(ds.tolist(), js.tolist())]


def _search(rows: DataFrame, is_query: Column, dim: int, k: int) -> DataFrame:
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    centre = np.array(rows.select(Summarizer.mean(array_to_vector("v")).alias("m")).first()["m"].toArray())
    coded = stored(blocks(rows, centre, dim), "ann-codes").withColumn("block", F.monotonically_increasing_id())
    n_blocks = coded.count()
    groups = max(1, -(-n_blocks // MAX_GROUP_BLOCKS), min(256, n_blocks // BLOCKS_PER_GROUP))
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = coded.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("qb", each(query_blocks))
    asked_once = rows.filter(is_query).select("vec_id", "v").dropDuplicates().withColumn("key", F.xxhash64("v"))
    right = (asked_once.withColumn("qb", F.pmod(F.xxhash64("vec_id", "key"), F.lit(query_blocks)).cast("int"))
             .withColumn("share", each(groups)).select("qb", "share", "vec_id", "key", "v"))

    def run(mine: pa.Table, asked: pa.Table) -> pa.Table:
        parts, out = [], []
        if mine.num_rows and asked.num_rows:
            for raw in zip(*(mine.column(c).to_pylist() for c in ("ids", "vectors", "codes", "norms", "alignment"))):
                ids, x, codes, norm, align = (np.frombuffer(b, t) for b, t in zip(raw, ("<i8", "<f8", "<u8", "<f8", "<f8")))
                parts.append((ids, x.reshape(len(ids), dim), codes.reshape(len(ids), -1), norm, align))
            q = asked.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            out = search_group(asked.column("vec_id").to_numpy(), asked.column("key").to_numpy(), q, parts, centre, k)
        return pa.table({"query_id": pa.array([r[0] for r in out], pa.int64()), "key": pa.array([r[1] for r in out], pa.int64()),
                         "vec_id": pa.array([r[2] for r in out], pa.int64()), "score": pa.array([r[3] for r in out], pa.float64())})

    found = left.groupBy("qb", "share").cogroup(right.groupBy("qb", "share")).applyInArrow(
        run, "query_id long, key long, vec_id long, score double")
    # queries are distinct by vec_id and vector, so each group returns k rows a query at most
    best = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k)
    return found.groupBy("query_id", "key").agg(best.alias("b"))


def nearest(embeddings: DataFrame, is_query: Column, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of each query's k nearest rows found."""
    rows = usable(embeddings)
    out = None
    for r in rows.select("dim").distinct().orderBy("dim").collect():
        part = _search(rows.filter(F.col("dim") == r["dim"]), is_query, r["dim"], k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return (out.select("query_id", F.posexplode("b").alias("p", "x"))
            .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"))
