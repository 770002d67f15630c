"""Counts, shares and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.numeric import share


def value_counts(df: DataFrame, keys: Sequence[str], of_shown: bool = False) -> DataFrame:
    """Count and share per key. Rows with a NULL key are not listed but count in the
    denominator, unless ``of_shown`` restricts it to the listed ones."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    shown = F.lit(True)
    for key in keys:
        shown = shown & F.col(key).isNotNull()
    listed = counts.where(shown)
    total = (listed if of_shown else counts).agg(F.sum("n")).scalar()
    return listed.select(*keys, "n", share(F.col("n"), total).alias("pct"))


def top_values(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent values; ties go to the smaller value."""
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), key).limit(k))


def late_rate(df: DataFrame, *keys: Column | str, digits: int | None = None) -> DataFrame:
    """Labelled rows and late rate per key; NULL keys are left out."""
    grouped = df.groupBy(*keys).agg(
        F.count(C.TARGET).alias("n"), F.avg(C.TARGET).alias("late_rate"))
    names = grouped.columns[:len(keys)]
    for name in names:
        grouped = grouped.where(F.col(name).isNotNull())
    if digits is not None:
        grouped = grouped.withColumn("late_rate", F.round("late_rate", digits))
    return grouped


def month_of(ts: str) -> Column:
    return F.date_format(F.col(ts), "yyyy-MM").alias("month")


def target_balance(df: DataFrame) -> DataFrame:
    """Totals, positives, their shares and the suggested class weight, in one row."""
    late, n = F.sum(C.TARGET), F.count(C.TARGET)
    return df.agg(
        n.alias("n"), late.cast("bigint").alias("late"), (n - late).cast("bigint").alias("on_time"),
        share(late, n).alias("late_pct"), share(n - late, n).alias("on_time_pct"),
        ((n - late) / F.greatest(late, F.lit(1))).alias("class_weight"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL count and share per column, from one pass."""
    one = df.agg(F.count("*").alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return one.select("_rows", F.expr(f"stack({len(columns)}, {pairs}) AS (column, nulls)")).select(
        "column", "nulls", share(F.col("nulls"), F.col("_rows")).alias("pct"))


def packages_per_order(df: DataFrame) -> DataFrame:
    """Orders with 1, 2 and 3 or more packages; packages without an order id are no order."""
    size = df.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(F.count("*").alias("packages"))
    label = F.when(F.col("packages") >= 3, "3+").otherwise(F.col("packages").cast("string"))
    return value_counts(size.select(label.alias("packages")), ["packages"]).withColumnRenamed("n", "orders")
