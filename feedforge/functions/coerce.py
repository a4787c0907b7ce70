"""Defaulting casts used at the edge of the system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing field in the log files.
NULL_TEXTS = ("\\N", "")


def safe_int(col: Column) -> Column:
    """Whole number, or 0 for null and for text that is not a whole number."""
    return F.coalesce(col.try_cast("bigint"), F.lit(0).cast("bigint"))


def safe_float(col: Column) -> Column:
    """Double, or 0.0 for null and bad text."""
    return F.coalesce(col.try_cast("double"), F.lit(0.0))


def finalize_int(col: Column, to: str = "bigint") -> Column:
    """Any numeric text to an integer: decimals are cut, bad values become 0."""
    return F.coalesce(col.try_cast("double").try_cast(to), F.lit(0).cast(to))


def blank_to_null(col: Column) -> Column:
    """Null for the texts that stand for a missing field."""
    return F.when(col.isin(*NULL_TEXTS), F.lit(None)).otherwise(col)


def finite(col: Column) -> Column:
    """0 for null, NaN and the infinities."""
    inf = F.lit(float("inf"))
    bad = col.isNull() | F.isnan(col) | (F.abs(col) == inf)
    return F.when(bad, F.lit(0.0)).otherwise(col)


def clamp(col: Column, low: float, high: float) -> Column:
    """``col`` held inside ``[low, high]``."""
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def finite_array(col: Column, low: float | None = None, high: float | None = None) -> Column:
    """Element-wise :func:`finite`, with an optional clamp."""

    def fix(x: Column) -> Column:
        value = finite(x.cast("double"))
        return value if low is None or high is None else clamp(value, low, high)

    return F.transform(col, fix)
