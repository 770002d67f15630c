"""Split by time, at exact row positions, without ranking every row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from .order_stats import running_totals


@dataclass(frozen=True)
class Cut:
    """The first row past a cut; ``at`` NULL means a row without a date, and
    ``key`` NULL that no row lies past the cut."""

    position: int
    at: datetime | None
    key: str | None

    def past(self, ts: Column, key: Column) -> Column:
        """Rows at or past the cut. Comparisons are with literals, so they reach the scan."""
        if self.key is None:
            return F.lit(False)
        tie = key >= F.lit(self.key)
        if self.at is None:
            return ts.isNull() & tie
        at = F.lit(self.at).cast("timestamp_ntz")
        return ts.isNull() | (ts > at) | ((ts == at) & tie)

    def bound(self, ts: Column, past: bool) -> Column:
        """What a row's date alone says about its side of the cut: looser than
        :meth:`past`, but simple enough to be pushed into a file scan."""
        if self.key is None:
            return F.lit(not past)
        if self.at is None:
            return ts.isNull() if past else F.lit(True)
        at = F.lit(self.at).cast("timestamp_ntz")
        return (ts.isNull() | (ts >= at)) if past else (ts <= at)


@dataclass(frozen=True)
class Cuts:
    rows: int
    cuts: tuple[Cut, ...]


def find_cuts(df: DataFrame, ts: str, key: str,
              positions: Callable[[int], Sequence[int]]) -> Cuts:
    """Rows found at the wanted positions of the order (ts, key), missing dates last.

    The first pass counts rows per day, which the calendar bounds. The second
    ranks only the days that hold a wanted position, range-partitioned by
    (ts, key): one day, or one instant, may hold any share of the rows. The few
    rows found come to the driver and turn later splits into plain filters.
    """
    day = F.to_date(F.col(ts))
    per_day = df.groupBy(day.alias("_day")).agg(F.count("*").alias("_rows"))
    # a table of calendar days: small whatever the data size
    by_day = Window.orderBy(F.col("_day").asc_nulls_last())
    starts = per_day.select(
        "_day", "_rows", F.sum("_rows").over(Window.partitionBy()).alias("_n"),
        (F.sum("_rows").over(by_day) - F.col("_rows")).alias("_start"))
    counted = [row.asDict() for row in starts.collect()]
    n = counted[0]["_n"] if counted else 0
    wanted = list(positions(n))

    inside: dict[int, dict] = {}
    for position in wanted:
        for row in counted:
            if row["_start"] <= position < row["_start"] + row["_rows"]:
                inside[position] = row
    if not inside:
        return Cuts(n, tuple(Cut(p, None, None) for p in wanted))

    days = {row["_day"]: row["_start"] for row in inside.values()}
    dated = [d for d in days if d is not None]
    hit = day.isNull() if None in days else F.lit(False)
    for d in dated:
        first = F.lit(datetime(d.year, d.month, d.day)).cast("timestamp_ntz")
        hit = hit | ((F.col(ts) >= first) & (F.col(ts) < first + F.expr("INTERVAL 1 DAY")))
    narrow = df.where(hit).select(
        day.alias("_day"), F.col(ts).alias("_ts"), F.col(key).alias("_key"),
        F.lit(1).cast("bigint").alias("_one"))
    ranked = running_totals(narrow, [F.col("_ts"), F.col("_key")], ["_one"], ["_day"])
    place = F.col("_one_before") + _start_of(days)
    found = {row["_place"]: row for row in
             ranked.withColumn("_place", place).where(F.col("_place").isin(list(inside)))
             .select("_place", "_ts", "_key").collect()}
    return Cuts(n, tuple(
        Cut(p, found[p]["_ts"], found[p]["_key"]) if p in found else Cut(p, None, None)
        for p in wanted))


def _start_of(days: dict) -> Column:
    start = F.lit(days.get(None, 0)).cast("bigint")
    for d, first in days.items():
        if d is not None:
            start = F.when(F.col("_day") == F.lit(d), F.lit(first)).otherwise(start)
    return start


def split_cuts(df: DataFrame, ts: str = "fecha_creacion", key: str = "package_id") -> Cuts:
    """Borders of the 67 / 17 / 16 split, in whole numbers to match any engine."""
    return find_cuts(df, ts, key, lambda n: [
        n * C.TRAIN_PERCENT // 100, n * C.TRAIN_VAL_PERCENT // 100])


def assign_split(df: DataFrame, cuts: Cuts, ts: str = "fecha_creacion",
                 key: str = "package_id") -> DataFrame:
    """Add ``split``: train, val or test. A projection, no shuffle."""
    train_end, val_end = cuts.cuts
    at, k = F.col(ts), F.col(key)
    return df.withColumn("split", F.when(val_end.past(at, k), "test")
                         .when(train_end.past(at, k), "val").otherwise("train"))


def only_split(split: DataFrame, cuts: Cuts, name: str, ts: str = "fecha_creacion") -> DataFrame:
    """The rows of one split. The date bounds are stated next to the label, because the
    label is a CASE that no scan can use, while the bounds skip files and row groups."""
    train_end, val_end = cuts.cuts
    at = F.col(ts)
    bounds = {"train": train_end.bound(at, False),
              "val": train_end.bound(at, True) & val_end.bound(at, False),
              "test": val_end.bound(at, True)}
    return split.where(bounds[name] & (F.col("split") == name))


def temporal_split(df: DataFrame, ts: str = "fecha_creacion",
                   key: str = "package_id") -> DataFrame:
    """Label each row train, val or test by its place in time."""
    return assign_split(df, split_cuts(df, ts, key), ts, key)


def fold_cuts(df: DataFrame, ts: str = "fecha_creacion", key: str = "package_id",
              folds: int = C.CV_FOLDS) -> Cuts:
    """Starts of the test blocks of an expanding time-series cross-validation."""
    return find_cuts(df, ts, key, lambda n: [
        n - (folds - k) * (n // (folds + 1)) for k in range(folds)])


def assign_block(df: DataFrame, cuts: Cuts, ts: str = "fecha_creacion",
                 key: str = "package_id") -> DataFrame:
    """Add ``block``: -1 before the first test block, else the fold the row tests.
    Fold ``k`` trains on every row with ``block < k`` and tests on ``block = k``."""
    block = F.lit(-1)
    for k, cut in enumerate(cuts.cuts):
        block = F.when(cut.past(F.col(ts), F.col(key)), k).otherwise(block)
    return df.withColumn("block", block)


def split_summary(split: DataFrame, ts: str = "fecha_creacion") -> DataFrame:
    """Rows, date range, positives and their share per split."""
    return split.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.min(ts).alias("first_date"), F.max(ts).alias("last_date"),
        F.sum(C.TARGET).cast("bigint").alias("positives"),
        (F.sum(C.TARGET) * 100.0 / F.count("*")).alias("positive_pct"))
