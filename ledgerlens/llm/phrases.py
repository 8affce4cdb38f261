"""Phrase collocations from depth-truncated suffix subtrees, partitioned vertically by word prefix.

A corpus' suffixes (from each word, DEPTH words deep) are too many for one tree, so they are dealt by
prefix. Prefixes start as single words; one that more suffixes share than a task may hold is extended
by a word, in one more scan of the text, as often as needed. Hash buckets of prefixes are then packed
into groups of at most the memory budget, and each group's subtree is built by itself: its suffixes
sorted word by word, a node at depth d being a run that agrees in d words, its count the total of its
leaves. Equal suffixes are counted together before the shuffle, so a very common phrase costs a row a
batch. A prefix that was extended takes its count from the scan that found it heavy.

A phrase is as frequent as its rarest word at most, so words under the least count end a suffix. They
are told apart by a bit filter of bounded size, which lets some rare words pass and no frequent one stop.

Edge cases: a null text is empty, a null lang is "und"; texts without words add nothing; repeated rows
count as often as they occur; equal scores are ordered by count and then by phrase; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import small_batches, stored

DEPTH = 4
MIN_COUNT = 30
TOP = 2000
INSIDE_PERCENT = 80          # a phrase inside one at least so frequent, of its own count, is dropped
SCORE_SCALE = 2_000_000
NO_LANG = "und"
MEMORY_SUFFIXES = 4 << 20    # suffixes that one subtree may hold
BUCKETS_PER_GROUP = 8
COUNTED = 300_000            # distinct suffixes that a mapping task counts before it hands them on
MAX_FILTER_BITS = 1 << 28    # 32 MB
HASH_SEED = 42

# Ends of a piece [.,;:!?\x0A-\x0D] and of a word [\x20\x09]: fixed values of the query contract.
_ENDS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\n" * 10 + b" ")


def pieces(text: str) -> Iterator[list[bytes]]:
    """The words of each piece; only ASCII letters change case."""
    for piece in text.encode().lower().translate(_ENDS).split(b"\n"):
        words = piece.split()
        if words:
            yield words


def _hash(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, HASH_SEED)


def _key(lang: Column, prefix: Column) -> Column:
    return F.xxhash64(F.concat(lang, F.lit("\0"), prefix))


# -- counting scans -----------------------------------------------------------------------------

def _counted(docs: DataFrame, count: Callable) -> DataFrame:
    """(lang, phrase, f) summed over all texts; ``count(counter, lang, text)`` counts one text."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def flush():
            for lang, c in found.items():
                if c:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()),
                         pa.array(list(c.values()), pa.int64())], names=["lang", "phrase", "f"])
            found.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                count(found.setdefault(lang, Counter()), lang, text)
            if sum(map(len, found.values())) > COUNTED:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(scan, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def word_counts(docs: DataFrame) -> DataFrame:
    def count(c: Counter, lang: str, text: str) -> None:
        c.update([w for words in pieces(text) for w in words])

    return _counted(docs, count)


def extended_counts(docs: DataFrame, heavy: dict[str, set[bytes]], runs: Callable, depth: int) -> DataFrame:
    """Counts of the ``depth``-word phrases that extend a heavy prefix by a word."""
    first = {lang: {p.split(b" ", 1)[0] for p in found} for lang, found in heavy.items()}

    def count(c: Counter, lang: str, text: str) -> None:
        mine, starts = heavy.get(lang), first.get(lang)
        if mine:
            for run in runs(text):
                for i in range(len(run) - depth + 1):
                    if run[i] in starts and (depth == 2 or b" ".join(run[i:i + depth - 1]) in mine):
                        c[b" ".join(run[i:i + depth])] += 1

    return _counted(docs, count)


# -- words that can be part of a phrase ------------------------------------------------------------

def frequent_filter(frequent: DataFrame) -> bytes:
    """A bit per hash value, set for every frequent word of any lang; 16 bits a word, MAX_FILTER_BITS at most."""
    n = frequent.count()
    size = 1 << 16
    while size < min(16 * n, MAX_FILTER_BITS):
        size <<= 1
    width = 4096                                     # bytes of one bitmap of the aggregate
    bit = frequent.select(F.pmod(F.xxhash64("phrase"), F.lit(size)).alias("bit"))
    parts = (bit.groupBy(F.expr(f"bit div {8 * width}").alias("part"))
             .agg(F.bitmap_construct_agg(F.col("bit") % (8 * width)).alias("bits")).collect())
    out = bytearray(size // 8)
    for r in parts:
        out[r["part"] * width:(r["part"] + 1) * width] = r["bits"]
    return bytes(out)


class _Known(dict):
    """word -> whether the filter passes it, worked out once a word."""

    def __init__(self, bits: bytes):
        self.bits, self.mask = bits, 8 * len(bits) - 1

    def __missing__(self, word: bytes) -> bool:
        if len(self) > 4 * COUNTED:
            self.clear()
        bit = _hash(word) & self.mask
        found = self[word] = bool(self.bits[bit >> 3] >> (bit & 7) & 1)
        return found


def run_cutter(bits: bytes) -> Callable:
    """runs(text): stretches of two or more words of one piece that all pass the filter."""
    known = _Known(bits)

    def runs(text: str) -> Iterator[list[bytes]]:
        for words in pieces(text):
            passed = [known[w] for w in words]
            if all(passed):
                if len(words) > 1:
                    yield words
                continue
            start = 0
            for i, ok in enumerate(passed):
                if not ok:
                    if i - start > 1:
                        yield words[start:i]
                    start = i + 1
            if len(words) - start > 1:
                yield words[start:]

    return runs


# -- vertical partitioning -----------------------------------------------------------------------

def pack_buckets(totals: np.ndarray, budget: int) -> np.ndarray:
    """Group of each bucket, filled in turn to at most ``budget``; a bucket above it has its own."""
    group, filled, out = 0, 0, np.zeros(len(totals), np.int64)
    for b, t in enumerate(totals.tolist()):
        if filled and filled + t > budget:
            group, filled = group + 1, 0
        out[b], filled = group, filled + t
    return out


def _prefix(suffix: bytes, heavy: list[set[bytes]]) -> tuple[bytes, int] | None:
    """Shortest prefix that is not heavy, and its depth; None if the whole suffix is heavy."""
    at = suffix.find(b" ")
    for depth, found in enumerate(heavy, 1):
        if at < 0:
            return None if suffix in found else (suffix, depth)
        if suffix[:at] not in found:
            return suffix[:at], depth
        at = suffix.find(b" ", at + 1)
    return (suffix if at < 0 else suffix[:at]), len(heavy) + 1


def suffixes(docs: DataFrame, bits: bytes, heavy: dict[int, dict[str, set[bytes]]], group_of: np.ndarray) -> DataFrame:
    """(part, lang, prefix_words, suffixes, counts): suffixes of a group, one a line, with their counts."""
    levels = sorted(heavy)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        runs = run_cutter(bits)
        n = len(group_of)

        def flush():
            rows = []
            for lang, c in found.items():
                mine = [heavy[d].get(lang, set()) for d in levels]
                start, groups, light = lang.encode() + b"\0", {}, {}
                heavy_words = mine[0] if mine else ()

                def group(prefix, depth):
                    return groups.setdefault((int(group_of[_hash(start + prefix) % n]), depth), ([], []))

                for s, k in c.items():
                    word = s[:s.find(b" ")]
                    lines = light.get(word)
                    if lines is None:
                        if word in heavy_words:
                            p = _prefix(s, mine)
                            if p is None:
                                continue
                            lines = group(*p)
                        else:
                            lines = light[word] = group(word, 1)
                    lines[0].append(s)
                    lines[1].append(k)
                rows += [(g, lang, d, b"\n".join(ss), np.array(ks, "<i8").tobytes())
                         for (g, d), (ss, ks) in groups.items()]
            found.clear()
            rows.sort(key=lambda r: r[0])
            for a in range(0, len(rows), 256):
                cols = list(zip(*rows[a:a + 256]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()),
                     pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())],
                    names=["part", "lang", "prefix_words", "suffixes", "counts"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                mine = []
                for run in runs(text):
                    if len(run) >= DEPTH:
                        mine += map(b" ".join, zip(*[run[i:] for i in range(DEPTH)]))
                    mine += [b" ".join(run[-k:]) for k in range(2, min(DEPTH, len(run) + 1))]
                found.setdefault(lang, Counter()).update(mine)
            if sum(map(len, found.values())) > COUNTED:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(scan, "part long, lang string, prefix_words int, suffixes binary, counts binary")


def subtree_nodes(lang: np.ndarray, prefix_words: np.ndarray, text: pa.Array, counts: np.ndarray,
                  min_count: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, a suffix of each node, count) of the nodes of one subtree, from two words on.

    The suffixes are sorted by word codes; a node is a run of equal first words, and its count the
    leaf total over the run."""
    words = pc.split_pattern(text, " ")
    length = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    codes = np.full((len(text), DEPTH), -1, np.int32)
    flat = words.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    codes[np.arange(DEPTH)[None, :] < length[:, None]] = flat
    order = np.lexsort((*codes.T[::-1], lang))
    codes, lang, prefix_words, counts = codes[order], lang[order], prefix_words[order], counts[order]
    changed = np.ones(len(order), bool)
    changed[1:] = lang[1:] != lang[:-1]
    for depth in range(1, DEPTH + 1):
        changed[1:] |= codes[1:, depth - 1] != codes[:-1, depth - 1]
        if depth == 1:
            continue
        start = np.flatnonzero(changed)
        total = np.add.reduceat(counts, start)
        keep = (codes[start, depth - 1] >= 0) & (prefix_words[start] <= depth) & (total >= min_count)
        yield depth, order[start[keep]], total[keep]


def subtrees(parts: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, f) of the frequent nodes of every group's subtree."""
    def build(group: pa.Table) -> pa.Table:
        lines, lang, depth, counts = [], [], [], []
        names = {}
        for la, d, s, c in zip(*(group.column(k).to_pylist() for k in ("lang", "prefix_words", "suffixes", "counts"))):
            found = s.split(b"\n")
            lines += found
            lang += [names.setdefault(la, len(names))] * len(found)
            depth += [d] * len(found)
            counts.append(np.frombuffer(c, "<i8"))
        by_code, out = list(names), ([], [], [])
        text = pa.array(lines, pa.binary()).cast(pa.string())
        lang = np.array(lang, np.int32)
        for d, leaf, total in subtree_nodes(lang, np.array(depth, np.int32), text, np.concatenate(counts), min_count):
            out[0].extend(by_code[k] for k in lang[leaf].tolist())
            out[1].extend(b" ".join(lines[i].split(b" ", d)[:d]).decode() for i in leaf.tolist())
            out[2].extend(total.tolist())
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())],
                        names=["lang", "phrase", "f"])

    return parts.groupBy("part").applyInArrow(build, "lang string, phrase string, f long")


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, memory: int = MEMORY_SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of up to DEPTH words with at least ``min_count`` occurrences,
    and (lang, n). The budget of a group is ``memory`` suffixes, less if the cluster's tasks would idle."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"),
                       F.coalesce("text", F.lit("")).alias("text"))
    words = stored(word_counts(docs), "phrase-words")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    frequent = words.filter(F.col("f") >= min_count)
    bits = frequent_filter(frequent)
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    budget = max(min_count, min(memory, -(-n // tasks)))

    # prefixes that too many suffixes share: at most n / budget at each depth
    heavy: dict[int, dict[str, set[bytes]]] = {}
    level, light, known = frequent, [], [frequent]
    for depth in range(1, DEPTH + 1):
        last = depth == DEPTH            # its suffixes are one leaf, whatever their number
        over = F.lit(False) if last else F.col("f") > budget
        light.append(level.filter(~over))
        found: dict[str, set[bytes]] = {}
        for r in [] if last else level.filter(over).select("lang", "phrase").collect():
            found.setdefault(r["lang"], set()).add(r["phrase"].encode())
        if not found:
            break
        heavy[depth] = found
        if depth > 1:
            known.append(level.filter(over))
        level = stored(extended_counts(docs, found, run_cutter(bits), depth + 1), "phrase-prefixes")

    size = max(1, BUCKETS_PER_GROUP * -(-n // budget))
    filled = light[0]
    for more in light[1:]:
        filled = filled.unionByName(more)
    totals = np.zeros(size, np.int64)
    for r in (filled.select(_unsigned_mod(_key(F.col("lang"), F.col("phrase")), size).alias("bucket"),
                            F.least("f", F.lit(budget)).alias("f"))
              .groupBy("bucket").agg(F.sum("f").alias("f")).collect()):
        totals[r["bucket"]] = r["f"]
    parts = suffixes(docs, bits, heavy, pack_buckets(totals, budget))
    out = subtrees(parts, min_count)
    for counts in known:
        out = out.unionByName(counts.filter(F.col("f") >= min_count))
    return stored(out, "phrases"), sizes


def _unsigned_mod(value: Column, size: int) -> Column:
    """A 64-bit hash, read as unsigned, modulo ``size``."""
    wrap = F.lit(pow(2, 64, size))
    return F.pmod(F.pmod(value, F.lit(size)) + F.when(value < 0, wrap).otherwise(F.lit(0)), F.lit(size))


# -- collocations ---------------------------------------------------------------------------------

def _part(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, memory: int = MEMORY_SUFFIXES) -> DataFrame:
    """Each lang's ``top`` phrases of 2 to DEPTH words by the score of their weakest cut."""
    found, sizes = frequent_phrases(docs, min_count, memory)
    found = found.withColumn("words", F.split("phrase", " "))
    candidates = found.filter(F.size("words") > 1).withColumnRenamed("f", "a")
    cut = (candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
           .select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("first"),
                   _part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest")))
    side = found.select("lang", "phrase", "f")
    cut = (cut.join(side.toDF("lang", "first", "l"), ["lang", "first"])
           .join(side.toDF("lang", "rest", "r"), ["lang", "rest"]))
    wide = "decimal(20,0)"
    score = F.expr(f"(cast(a as {wide}) * {SCORE_SCALE}) div (cast(l as {wide}) + cast(r as {wide}))")
    weakest = (cut.withColumn("score", score).groupBy("lang", "phrase", "a")
               .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
               .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    longer = (candidates.filter(F.size("words") > 2)
              .withColumn("size", F.explode(F.sequence(F.lit(2), F.size("words") - 1)))
              .withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)))
              .select("lang", _part(F.col("at"), F.col("size")).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("most")))
    inside = F.col("most").cast(wide) * 100 >= F.col("a").cast(wide) * INSIDE_PERCENT
    kept = weakest.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(inside, F.lit(False))).drop("most")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
            .join(sizes, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


SQL = f"""
WITH texts AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9),
                   'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9) || ' ') AS t
  FROM documents),
pieces AS (SELECT lang, unnest(string_split(t, chr(10))) AS piece FROM texts),
numbered AS (SELECT lang, piece, row_number() OVER () AS id FROM pieces),
words AS (
  SELECT lang, id, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT lang, id, list_filter(string_split(piece, ' '), lambda x: x <> '') AS w FROM numbered)),
grams AS (
  SELECT lang, word AS w1, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3, lead(word, 3) OVER p AS w4
  FROM words WINDOW p AS (PARTITION BY id ORDER BY i)),
grown AS (
  SELECT lang, d, CASE d WHEN 1 THEN w1 WHEN 2 THEN w1 || ' ' || w2 WHEN 3 THEN w1 || ' ' || w2 || ' ' || w3
                  ELSE w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 END AS phrase
  FROM grams, range(1, {DEPTH + 1}) t(d)),
counts AS (SELECT lang, phrase, d, count(*) AS f FROM grown WHERE phrase IS NOT NULL GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE d = 1 GROUP BY lang),
candidates AS (
  SELECT lang, phrase, string_split(phrase, ' ') AS w, d, f AS a FROM counts WHERE d >= 2 AND f >= {MIN_COUNT}),
parts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:], ' ') AS rest
  FROM candidates, range(1, {DEPTH}) t(k) WHERE k < d),
lefts AS MATERIALIZED (SELECT c.*, x.f AS l FROM parts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first_part),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l, y.f AS r, ({SCORE_SCALE}::HUGEINT * c.a) // (l::HUGEINT + y.f) AS score
  FROM lefts c JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest),
weakest AS (
  SELECT lang, phrase, a, l, r, score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT DISTINCT c.lang, array_to_string(c.w[i:i + s - 1], ' ') AS phrase, c.a
  FROM candidates c, range(2, {DEPTH}) t(s), range(1, {DEPTH}) u(i) WHERE s < c.d AND i + s - 1 <= c.d),
longest AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL),
kept AS (
  SELECT w.* FROM weakest w LEFT JOIN longest p ON p.lang = w.lang AND p.phrase = w.phrase
  WHERE p.most IS NULL OR 100::HUGEINT * p.most < {INSIDE_PERCENT}::HUGEINT * w.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN sizes USING (lang)
QUALIFY rank <= {TOP}
"""
