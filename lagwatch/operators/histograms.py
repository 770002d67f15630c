"""Histograms, box statistics and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..session import pin
from .joins import BROADCAST_ROWS
from .order_stats import exact_quantiles, long_form


def _bin_index(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin of a value; the last bin includes its upper edge. A constant
    column is given a unit-wide range around its value."""
    low_, high_ = _range(low, high)
    place = F.floor((x - low_) * F.lit(float(bins)) / (high_ - low_))
    return F.when(place >= bins, bins - 1).otherwise(place).cast("int")


def _range(low: Column, high: Column) -> tuple[Column, Column]:
    flat = low == high
    return F.when(flat, low - 0.5).otherwise(low), F.when(flat, high + 0.5).otherwise(high)


def equal_width_histogram(df: DataFrame, value: Column, bins: int,
                          group_cols: Sequence[str] = ()) -> DataFrame:
    """All bins of every group, empty ones too: ``bin, low, high, n, density``.

    The ranges are one row per group and broadcast only when counted as few.
    """
    groups = list(group_cols)
    keys = groups or ["_all"]
    values = (df if groups else df.withColumn("_all", F.lit(0))).select(*keys, value.cast("double").alias("_x"))
    values = values.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    # one row per group, read again for the frame: fixed once instead of computed twice
    ranges = pin(values.groupBy(*keys).agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_n")))

    def same(left: str, right: str) -> Column:
        test = F.lit(True)
        for key in keys:
            test = test & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
        return test

    small = F.broadcast(ranges) if ranges.count() <= BROADCAST_ROWS else ranges
    placed = values.alias("v").join(small.alias("r"), same("v", "r")).select(
        *[F.col(f"v.{key}") for key in keys],
        _bin_index(F.col("_x"), F.col("_lo"), F.col("_hi"), bins).alias("bin"))
    counts = placed.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    frame = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = frame.alias("f").join(
        counts.alias("c"), same("f", "c") & (F.col("f.bin") == F.col("c.bin")), "left")
    low_, high_ = _range(F.col("f._lo"), F.col("f._hi"))
    width = (high_ - low_) / F.lit(float(bins))
    n = F.coalesce(F.col("c.n"), F.lit(0))
    return full.select(
        *[F.col(f"f.{g}") for g in groups], F.col("f.bin"),
        (low_ + F.col("f.bin") * width).alias("low"),
        (low_ + (F.col("f.bin") + 1) * width).alias("high"),
        n.cast("bigint").alias("n"), (n / (F.col("f._n") * width)).alias("density"))


def edge_histogram(df: DataFrame, value: str, edges: Sequence[int]) -> DataFrame:
    """Counts between given edges: left-closed, the last bin closed on both sides,
    values outside dropped. Share is of all rows."""
    x = F.col(value)
    last = len(edges) - 2
    label = F.lit(None).cast("int")
    for i in range(last, -1, -1):
        upper = (x <= edges[i + 1]) if i == last else (x < edges[i + 1])
        label = F.when((x >= edges[i]) & upper, i).otherwise(label)
    # one pass: the unlabelled rows are counted too, for the denominator
    counts = df.select(label.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    frame = df.sparkSession.createDataFrame(
        [(i, float(edges[i]), float(edges[i + 1])) for i in range(last + 1)],
        "bin int, low double, high double")
    n = F.coalesce(F.col("c.n"), F.lit(0))
    return frame.alias("f").join(counts.alias("c"), F.col("f.bin") == F.col("c.bin"), "left").select(
        F.col("f.bin"), "low", "high", n.cast("bigint").alias("n"),
        F.try_divide(n * 100.0, total).alias("pct"))


def box_stats(df: DataFrame, group: str, value: str, groups: Sequence[str]) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers and outliers per listed group (a fixed short list)."""
    values = df.where(F.col(group).isin(list(groups)) & F.col(value).isNotNull()).select(group, value)
    wide = exact_quantiles(values, F.col(value), [0.25, 0.5, 0.75], [group]).groupBy(group).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
          for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    x = F.col(f"v.{value}")
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - iqr * 1.5, F.col("q3") + iqr * 1.5
    inside = (x >= low) & (x <= high)
    return (values.alias("v").join(F.broadcast(wide).alias("q"), F.col(f"v.{group}") == F.col(f"q.{group}"))
            .groupBy(F.col(f"v.{group}").alias(group))
            .agg(F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
                 # a whisker never retreats inside the box
                 F.least(F.min(F.when(inside, x)), F.first("q1")).alias("whisker_low"),
                 F.greatest(F.max(F.when(inside, x)), F.first("q3")).alias("whisker_high"),
                 F.count_if(~inside).alias("outliers"), F.count("*").alias("n")))


def target_correlations(df: DataFrame, columns: Sequence[str], target: str = C.TARGET) -> DataFrame:
    """Pearson correlation of each column with the target over the rows that have
    both; all columns in one aggregate. A constant column gives NULL."""
    def r(name: str) -> Column:
        x = F.col(name).cast("double")
        both = x.isNotNull() & ~F.isnan(x) & F.col(target).isNotNull()
        value = F.corr(F.when(both, x), F.when(both, F.col(target).cast("double")))
        return F.when(~F.isnan(value), value).alias(name)

    return long_form(df.agg(*[r(name) for name in columns]), columns, value="corr")


def strongest(correlations: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` largest positive and the ``k`` largest negative correlations."""
    up = correlations.where(F.col("corr") > 0).orderBy(F.desc("corr"), "feature").limit(k)
    down = correlations.where(F.col("corr") < 0).orderBy("corr", "feature").limit(k)
    return up.withColumn("sign", F.lit("positive")).unionByName(down.withColumn("sign", F.lit("negative")))
