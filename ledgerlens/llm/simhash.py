"""SimHash near-duplicates, found through segment popcounts.

A fingerprint's 64 bits are cut into 32 segments of two. The popcounts of the segments (0, 1 or 2)
embed it in a grid, where the Manhattan distance never exceeds the number of differing bits. Two
fingerprints at most ``distance`` = 3 bits apart therefore lie, in one of the two halves of the grid
(16 segments each), at a Manhattan distance of at most 1: the range join on the grid takes, for each
half, a fingerprint's own cell and the cells one step away, and each pair met there is verified on
the fingerprints themselves. Cells one step apart differ in the parity of their sum, so only even
cells are looked up from their neighbours' side.

Equal fingerprints are grouped before. Inside a cell a spanning forest of the verified links is
returned, not all pairs, which leaves reachability as it is. Cells are found by a shuffle and a sort
in Spark; a task reads its sorted rows in batches and keeps only the cell at hand.

Edge cases: null and empty texts and those without words have fingerprint zero and are linked like
any other; fewer words than the shingle length are one shingle; a null doc_id counts as no smallest
id; repeated rows come back as often as they came; further columns are left out of ``simhash_groups``
and kept by ``keep_one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import small_batches, stored
from ledgerlens.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
_EVEN = 0x55555555
_BLOCK = 1024
_SMALL = 8          # fingerprints of a cell whose pairs are all looked at


def fingerprint_of(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """The majority bits of the shingles' XXH64, as an unsigned integer."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        part = hashes[a:a + (1 << 14)].astype("<u8").view(np.uint8)
        counts += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` and ``fp`` long: the fingerprint's 64 bits."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.array([fingerprint_of(t, shingle) for t in s], np.uint64).view(np.int64))

    return docs.withColumn("fp", run(F.col("text")))


def _half(half: int) -> Column:
    """The popcounts of one half's 16 segments, two bits each, as a long."""
    bits = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
    return bits.bitwiseAND(F.lit(_EVEN)) + F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(_EVEN))


def grid_rows(prints: DataFrame) -> DataFrame:
    """(cell, guest, fp): each fingerprint in its own cell of either half, and, where its cell is
    even, as a guest in the cells one step away."""
    steps = F.expr("""transform(sequence(0, 15), i -> struct(i as i, (shiftright(key, 2 * i) & 3L) as c))""")
    out = None
    for half in (0, 1):
        own = prints.select("fp", _half(half).alias("key"))
        odd = F.expr("aggregate(steps, 0L, (s, x) -> s + x.c) % 2 = 1")
        guests = (own.withColumn("steps", steps).filter(~odd).select("fp", F.explode(F.expr("""concat(
              transform(filter(steps, x -> x.c < 2), x -> key + shiftleft(1L, 2 * x.i)),
              transform(filter(steps, x -> x.c > 0), x -> key - shiftleft(1L, 2 * x.i)))""")).alias("key")))
        both = own.select("fp", "key", F.lit(False).alias("guest")).unionByName(
            guests.select("fp", "key", F.lit(True).alias("guest")))
        both = both.select((F.col("key") * 2 + half).alias("cell"), "guest", "fp")
        out = both if out is None else out.unionByName(both)
    return out


def _forest(hosts: np.ndarray, guests: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that span what the verified pairs host-host and host-guest connect."""
    all_fp = np.concatenate((hosts, guests))
    label = np.arange(len(all_fp))
    out = []
    for a in range(0, len(hosts), _BLOCK):
        near = np.bitwise_count(hosts[a:a + _BLOCK, None] ^ all_fp[None, :]) <= bits
        for x in range(len(near)):
            met = np.flatnonzero(near[x])
            met = met[label[met] != label[a + x]]
            if len(met):
                others, first = np.unique(label[met], return_index=True)
                out += [(int(all_fp[a + x]), int(all_fp[y])) for y in met[first]]
                label[np.isin(label, others)] = label[a + x]
    return out


def _cell_links(cell: np.ndarray, guest: np.ndarray, fp: np.ndarray, bits: int) -> np.ndarray:
    """Verified links inside whole cells, rows sorted by cell: all of small cells, a spanning forest of others."""
    cut = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
    size = np.diff(cut)
    small = np.repeat(size <= _SMALL, size)
    found = []
    for step in range(1, _SMALL):
        i = np.flatnonzero(small[:-step] & (cell[step:] == cell[:-step]) & ~(guest[step:] & guest[:-step]))
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= bits]
        found.append(np.stack((fp[i], fp[i + step]), 1))
    for s, k in zip(cut[:-1][size > _SMALL].tolist(), size[size > _SMALL].tolist()):
        g, f = guest[s:s + k], fp[s:s + k]
        if not g.all():
            found.append(np.array(_forest(f[~g], f[g], bits), np.uint64).reshape(-1, 2))
    return np.concatenate(found) if found else np.empty((0, 2), np.uint64)


def links(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between different fingerprints that keep every reachability of the full set."""
    if not 0 <= bits <= 3:
        raise ValueError("the two-half grid covers distances of 0 to 3 bits")
    spark = prints.sparkSession
    rows = grid_rows(prints)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def close(cell, guest, fp):
            e = _cell_links(cell, guest, fp, bits).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

        for b in batches:
            part = [b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy().view(np.uint64)]
            if not len(part[0]):
                continue
            kept.append(part)
            if kept[0][0][0] == part[0][-1]:
                continue                       # one cell, not ended yet
            cell, guest, fp = (np.concatenate([p[k] for p in kept]) for k in range(3))
            last = np.searchsorted(cell, cell[-1])
            kept = [[cell[last:], guest[last:], fp[last:]]]
            yield close(cell[:last], guest[:last], fp[:last])
        if kept:
            yield close(*(np.concatenate([p[k] for p in kept]) for k in range(3)))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    return rows.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(meet, "a long, b long")


def _labelled(docs: DataFrame, shingle: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(documents with fp, (fp, label) for every fingerprint that is linked to another)."""
    marked = stored(with_fingerprint(docs, shingle), "fingerprints")
    found = stored(links(marked.select("fp").distinct(), bits), "fingerprint-links")
    small_batches(docs.sparkSession)
    return marked, components(found).select(F.col("node").alias("fp"), F.col("root").alias("label"))


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id reachable over links."""
    marked, label = _labelled(docs.select("doc_id", "text"), shingle, bits)
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(label, "fp", "left")
    least = least.withColumn("label", F.coalesce("label", "fp"))
    by_label = least.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = least.join(by_label, "label").select("fp", "component_id")
    return marked.select("doc_id", "fp").join(ids, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """One document of every group: the smallest doc_id (a null one last), and of rows that share it
    the one with the smallest row hash; equal rows are one document."""
    columns = docs.columns
    marked, label = _labelled(docs.withColumn("_row", F.xxhash64(*columns)), shingle, bits)
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_row").alias("r"))
    least = marked.groupBy("fp").agg(F.min(rank).alias("k")).join(label, "fp", "left")
    chosen = (least.groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("k").alias("k"))
              .select(F.col("k.d").alias("_d"), F.col("k.r").alias("_r")).distinct())
    return (marked.join(chosen, F.col("_row").eqNullSafe(F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
            .select(*columns).distinct())
