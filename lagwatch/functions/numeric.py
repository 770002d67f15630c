"""Null-safe arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cap(x: Column, upper: float) -> Column:
    """Clip from above; NULL stays NULL (``least`` would return the bound)."""
    return F.when(x > upper, F.lit(float(upper))).otherwise(x)


def floor_at(x: Column, lower: float) -> Column:
    """Clip from below; NULL stays NULL."""
    return F.when(x < lower, F.lit(float(lower))).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL for a zero denominator."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def ratio_or_zero(a: Column, b: Column) -> Column:
    """``a / b``, 0 where the denominator is zero."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """Percentage of a whole."""
    return ratio(part * F.lit(100.0), whole)


def clean_key(x: Column) -> Column:
    """Upper-case, trimmed, single-spaced form of a category name (opt-in)."""
    return F.upper(F.trim(F.regexp_replace(x, r"\s+", " ")))
