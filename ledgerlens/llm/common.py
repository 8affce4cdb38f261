"""Helpers shared by the operators: table reading, hash splits, stored intermediate tables, batch bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import scratch_path

# Separators of a word, the complement of [^\x20\x09-\x0D]: fixed values of the query contract.
SEPARATORS = " \t\n\x0b\f\r"

# Rows and bytes handed to Python at once: whichever is reached first closes a batch.
ARROW_ROWS = 512
ARROW_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows and bytes of one Arrow batch for the Python stages of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back, so that later
    steps neither recompute it nor depend on one executor's copy."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_remainder(col: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; null stays null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(modulus)


def held_out(modulus: int, remainder: int, col: str = "doc_id") -> Column:
    """True for rows kept out of learning. A null id has no remainder and belongs to the learning rows."""
    return F.coalesce(hash_remainder(col, modulus) == F.lit(remainder), F.lit(False))


class WordCache:
    """A per-process memo of pure per-word results, in two generations so that it stays bounded:
    when the young one is full it becomes the old one, and frequent words move back on use.

    ``limit`` bounds the entries and ``limit_bytes`` their rough size (a word's length stands for its
    result's, times ``per_char``). Words of more than LONG_WORD characters are computed anew in each
    batch and forgotten with it."""

    LONG_WORD = 256

    def __init__(self, compute, limit: int = 400_000, limit_bytes: int = 96 << 20, per_char: int = 8):
        self.compute, self.limit, self.limit_bytes, self.per_char = compute, limit, limit_bytes, per_char
        self.young: dict = {}
        self.old: dict = {}
        self.used = 0
        self.passing: list = []

    def look_up(self, words: set) -> dict:
        """A dict that holds every word of ``words``; its long words are gone after the next call."""
        for w in self.passing:
            del self.young[w]
        self.passing = []
        missing = words.difference(self.young)
        if missing:
            if len(self.young) + len(missing) > self.limit or self.used > self.limit_bytes:
                self.old, self.young, self.used = self.young, {}, 0
                missing = words
            old, fresh, young = self.old, [], self.young
            for w in missing:
                v = old.get(w)
                if v is None:
                    fresh.append(w)
                else:
                    young[w] = v
            if fresh:
                young.update(zip(fresh, self.compute(fresh)))
                self.passing = [w for w in fresh if len(w) > self.LONG_WORD]
            self.used += self.per_char * sum(map(len, missing)) + 200 * len(missing)
            if self.passing:
                self.used -= sum(self.per_char * len(w) + 200 for w in self.passing)
        return self.young
