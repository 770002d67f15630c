"""Exact order statistics without a single big partition.

Spark's ``percentile`` keeps every distinct value of a group in one buffer, and a
window without partition keys sorts everything in one task. Here the distinct
values are range-partitioned, so the sort is balanced however the values are
spread, and only one total per partition and group is carried forward.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

_RANGE, _GROUP = "_range", "_group"


def _ranged(df: DataFrame, groups: Sequence[str], order_cols: Sequence[Column], ranges: int | None) -> DataFrame:
    """Rows with their range number and their group as one struct, stored as Parquet: two
    evaluations of a range partitioning may draw different borders, so it is evaluated once.

    Range number and group are joined and windowed on together by plain equality, so the
    exchange is the same for both; a struct of NULLs equals another, as groups need.
    """
    keys = [*[F.col(g) for g in groups], *order_cols]
    dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    group = F.struct(*groups) if groups else F.struct(F.lit(0).alias("all"))
    return written(dealt.withColumns({_RANGE: F.spark_partition_id(), _GROUP: group}), "ranges")


def running_totals(df: DataFrame, order_cols: Sequence[Column], measures: Sequence[str],
                   group_cols: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Add, for each measure ``m``, ``m_before`` (sum over the rows of the group that
    sort earlier) and ``m_total`` (sum over the group).

    ``order_cols`` must order the rows of a group strictly. ``ranges`` sets how many ranges the
    rows are dealt over; without it the session's number of shuffle partitions holds, which the
    adaptive planner may merge where ranges are small.
    """
    groups = list(group_cols)
    ranged = _ranged(df, groups, order_cols, ranges)

    # one row per (range, group): at most ranges + groups rows, as ranges follow groups
    sums = ranged.groupBy(_RANGE, _GROUP).agg(*[F.sum(m).alias(m) for m in measures])
    in_group = Window.partitionBy(_GROUP)
    earlier = in_group.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        _RANGE, _GROUP,
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_{m}_offset") for m in measures],
        *[F.sum(m).over(in_group).alias(f"_{m}_total") for m in measures],
    )
    if not groups:
        offsets = F.broadcast(offsets)  # one row per range: bounded by the partition count

    local = (Window.partitionBy(_RANGE, _GROUP).orderBy(*order_cols)
             .rowsBetween(Window.unboundedPreceding, -1))
    with_local = ranged.withColumns(
        {f"_{m}_local": F.coalesce(F.sum(m).over(local), F.lit(0)) for m in measures})
    joined = with_local.alias("r").join(offsets.alias("o"), _same_range())
    return joined.select(
        *[F.col(f"r.{name}") for name in df.columns],
        *[(F.col(f"o._{m}_offset") + F.col(f"r._{m}_local")).alias(f"{m}_before") for m in measures],
        *[F.col(f"o._{m}_total").alias(f"{m}_total") for m in measures],
    )


def _same_range() -> Column:
    return (F.col(f"r.{_RANGE}") == F.col(f"o.{_RANGE}")) & (F.col(f"r.{_GROUP}") == F.col(f"o.{_GROUP}"))


def previous_values(df: DataFrame, order_cols: Sequence[str], values: Sequence[str],
                    group_cols: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Add ``{v}_prev``: the value of the row before, in the order within the group.

    Like a lag, but a group of any size is spread over ranges: each range looks back
    on its own, and its first row takes the last row of the range before.
    ``order_cols`` must order the rows of a group strictly.
    """
    groups = list(group_cols)
    ranged = _ranged(df, groups, [F.col(c) for c in order_cols], ranges)
    row = F.struct(*values)
    lasts = ranged.groupBy(_RANGE, _GROUP).agg(F.max_by(row, F.struct(*order_cols)).alias("_last"))
    carried = lasts.select(_RANGE, _GROUP, F.lag("_last").over(
        Window.partitionBy(_GROUP).orderBy(_RANGE)).alias("_carry"))
    local = F.lag(row).over(Window.partitionBy(_RANGE, _GROUP).orderBy(*order_cols))
    joined = ranged.withColumn("_local", local).alias("r").join(carried.alias("o"), _same_range())
    before = F.coalesce(F.col("r._local"), F.col("o._carry"))
    return joined.select(*[F.col(f"r.{name}") for name in df.columns],
                         *[before[v].alias(f"{v}_prev") for v in values])


def exact_quantiles(df: DataFrame, value: Column, probs: Sequence[float],
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles: one row per group and probability, with
    columns ``prob``, ``quantile`` and ``n`` (values that are neither NULL nor NaN).
    """
    groups = list(group_cols)
    x = value.cast("double")
    # repeated values meet on the map side, so a frequent value is no hot spot
    counts = (df.select(*groups, x.alias("_x"))
              .where(F.col("_x").isNotNull() & ~F.isnan("_x"))
              .groupBy(*groups, "_x").agg(F.count("*").alias("_n")))
    ranked = running_totals(counts, [F.col("_x")], ["_n"], groups)

    total, before = F.col("_n_total"), F.col("_n_before")
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    # a value serves a probability when it holds the lower or the upper rank
    served = F.filter(
        F.transform(wanted, lambda p: F.struct(
            p.alias("prob"),
            F.floor((total - 1) * p).alias("low"),
            F.ceil((total - 1) * p).alias("high"))),
        lambda s: (_holds(s["low"], before) | _holds(s["high"], before)))
    hits = (ranked.where(F.size(served) > 0)
            .select(*groups, "_x", "_n_before", "_n", "_n_total", F.explode(served).alias("s")))
    picked = hits.groupBy(*groups, F.col("s.prob").alias("prob")).agg(
        F.max(F.when(_holds(F.col("s.low"), before), F.col("_x"))).alias("_low"),
        F.max(F.when(_holds(F.col("s.high"), before), F.col("_x"))).alias("_high"),
        F.first("_n_total").alias("n"))
    place = (F.col("n") - 1) * F.col("prob")
    return picked.select(
        *groups, "prob",
        (F.col("_low") + (F.col("_high") - F.col("_low")) * (place - F.floor(place)))
        .alias("quantile"),
        F.col("n").cast("bigint").alias("n"))


def _holds(rank: Column, before: Column) -> Column:
    return (rank >= before) & (rank < before + F.col("_n"))


def exact_medians(df: DataFrame, value: Column, group_cols: Sequence[str] = ()) -> DataFrame:
    """Median per group: columns ``median`` and ``n``."""
    return (exact_quantiles(df, value, [0.5], group_cols)
            .select(*group_cols, F.col("quantile").alias("median"), "n"))


def global_rank(df: DataFrame, order_cols: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number the rows 0 … n-1 in a strict order, and add the row count as ``n``."""
    ranked = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), order_cols, ["_one"])
    return ranked.select(*df.columns, F.col("_one_before").alias(name), F.col("_one_total").alias("n"))


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (),
              name: str = "feature", value: str = "value", kind: str = "double") -> DataFrame:
    """One row per listed column: its name and its value, next to the kept columns."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS {kind})" for c in columns)
    return df.select(*keep, F.expr(f"stack({len(columns)}, {pairs}) AS ({name}, {value})"))
