"""Lookups in small tables and null-safe joins.

A lookup is always an ordinary left join. The tables looked up in are written ones (dictionaries,
profiles), so the planner knows their size: a small one is broadcast, a large one is sort-merged with
skewed keys split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, key: Column | str, table: DataFrame, table_key: str, table_value: str,
           out: str, default=None) -> DataFrame:
    """``df`` plus column ``out`` = table_value where table_key = key (``default`` if absent)."""
    key_col = F.col(key) if isinstance(key, str) else key
    t = table.select(F.col(table_key).alias(f"__lk_{out}"), F.col(table_value).alias(f"__lv_{out}"))
    j = df.join(t, key_col == F.col(f"__lk_{out}"), "left")
    return j.withColumn(out, F.coalesce(F.col(f"__lv_{out}"), F.lit(default))).drop(f"__lk_{out}", f"__lv_{out}")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which a null key meets a null key; the keys of ``left`` stay."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}" if c in keys else c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, on).drop(*[f"_right_{k}" for k in keys])
