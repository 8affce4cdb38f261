"""Scalar column expressions shared by batch and streaming jobs.

All are built-in Spark expressions (JVM side, inside whole-stage codegen); no Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed(c: str | Column, dp: int) -> Column:
    """Round half up to ``dp`` decimals as ``floor(x*10^dp + 0.5) / 10^dp`` on doubles.

    The same arithmetic is used in the SQL oracle so both engines agree to the bit.
    """
    scale = float(10 ** dp)
    return (F.floor(col(c).cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double")


def safe_div(a: str | Column, b: str | Column) -> Column:
    """Division that yields NULL for a zero divisor (ANSI mode raises on ``x/0``)."""
    return F.try_divide(col(a), col(b))


def differs(a: str | Column, b: str | Column) -> Column:
    """1 when the two values differ, with NULL on either side counting as different."""
    return F.coalesce(col(a) != col(b), F.lit(True)).cast("int")


# --- time parts (PRJ-1..4) -------------------------------------------------------------

def hour_of(ts: str | Column) -> Column:
    return F.hour(col(ts))


def day_of_week(ts: str | Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(col(ts))


def is_weekend(ts: str | Column) -> Column:
    return F.coalesce(F.weekday(col(ts)) >= 5, F.lit(False)).cast("int")


def day_of_month(ts: str | Column) -> Column:
    return F.dayofmonth(col(ts))


# --- amounts (PRJ-5..8) ------------------------------------------------------------------

def coerce_amount(c: str | Column, from_string: bool = False) -> Column:
    """Numeric coercion: unparsable text, NULL and NaN become 0."""
    x = F.trim(col(c)).try_cast("double") if from_string else col(c).cast("double")
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0))


def log1p_amount(c: str | Column) -> Column:
    """log(1 + x); amounts of -1 or below (undefined) give 0 and are flagged by ``bad_amount``."""
    return F.coalesce(F.log1p(col(c)), F.lit(0.0))


def bad_amount(c: str | Column) -> Column:
    return (col(c) <= F.lit(-1.0)).cast("int")


def amount_ratio(paid: str | Column, received: str | Column) -> Column:
    return F.when(col(received) > 0, col(paid) / col(received)).otherwise(F.lit(1.0))


def log_amount_ratio(ratio: str | Column) -> Column:
    return F.log(F.least(F.greatest(col(ratio), F.lit(0.01)), F.lit(100.0)))


# --- display (PRJ-13) ----------------------------------------------------------------------

def short_id(c: str | Column, n: int = 12) -> Column:
    return F.left(col(c).cast("string"), F.lit(n))


def money(c: str | Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(col(c), 2))


def score_text(c: str | Column) -> Column:
    return F.format_string("%.3f", col(c))
