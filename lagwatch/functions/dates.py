"""Time stamps, durations and calendar features. All results are time-zone free."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# serial day numbers the spreadsheet calendar can hold: up to 9999-12-31
_MAX_SERIAL = 2958465


def iso_timestamp(text: Column) -> Column:
    """ISO text to a time stamp; anything else is NULL."""
    return text.try_cast("timestamp_ntz")


def serial_timestamp(text: Column) -> Column:
    """Spreadsheet day number (days after 1899-12-30, fractions allowed)."""
    days = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    days = F.when(F.abs(days) <= _MAX_SERIAL, days)
    seconds = F.round(days * 86400, 6).cast("decimal(18,6)")
    origin = F.lit("1899-12-30").cast("timestamp_ntz")
    return origin + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def mixed_timestamp(text: Column) -> Column:
    """Day numbers and ISO text in one column. A number is never read as a year."""
    text = text.cast("string")
    return F.when(text.rlike(_NUMBER), serial_timestamp(text)).otherwise(iso_timestamp(text))


def lifecycle_timestamp(text: Column, epoch_millis: Column) -> Column:
    """``… UTC`` or ``…Z`` text, else an epoch-milliseconds string, as UTC wall time."""
    bare = F.regexp_replace(F.trim(text), r"( UTC|Z)$", "")
    origin = F.lit("1970-01-01").cast("timestamp_ntz")
    seconds = (epoch_millis.try_cast("bigint") / F.lit(1000)).cast("decimal(18,6)")
    epoch = origin + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.coalesce(iso_timestamp(bare), epoch)


def hours_between(start: Column, end: Column) -> Column:
    """Hours from ``start`` to ``end`` as a double."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3.6e9)


def calendar(ts: Column, weekend_if_null: int | None = 0) -> dict[str, Column]:
    """Weekday (Monday = 0), hour, month and weekend flag.

    In the dataset a missing date counts as "not weekend"; in a scoring row it
    stays NULL.
    """
    weekday = F.weekday(ts)
    return {
        "dia_semana": weekday,
        "hora_creacion": F.hour(ts),
        "mes": F.month(ts),
        "es_fin_semana": F.coalesce((weekday >= 5).cast("int"), F.lit(weekend_if_null).cast("int")),
    }
