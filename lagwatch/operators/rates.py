"""Historical late rates, learnt on the training split only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..session import pin
from .joins import HOTTEST_SHARE, lookup, row_bytes

# level name -> key columns -> feature name
LEVELS = {
    "carrier": (["carrier"], "tasa_fallo_carrier"),
    "region": (["region"], "tasa_fallo_region"),
    "carrier_region": (["carrier", "region"], "tasa_fallo_carrier_region"),
}


def rate_table(train: DataFrame, min_count: int = 0) -> DataFrame:
    """All rates in one tidy table: ``level, carrier, region, late, n, rate``.

    The facts are read once and reduced to (carrier, region) on the map side; the
    other levels come from that small result. A level leaves out rows whose own
    key is NULL, as a grouping of the facts by that key would.
    """
    pairs = train.groupBy("carrier", "region").agg(
        F.sum(C.TARGET).alias("late"), F.count(C.TARGET).alias("n"))
    levels = pairs.groupingSets([["carrier", "region"], ["carrier"], ["region"], []],
                                "carrier", "region").agg(
        F.sum("late").cast("bigint").alias("late"), F.sum("n").cast("bigint").alias("n"),
        F.grouping_id().alias("_gid"))
    # grouping id bits: carrier, region; a set bit means "rolled up"
    named = levels.select(
        F.when(F.col("_gid") == 0, "carrier_region").when(F.col("_gid") == 1, "carrier")
         .when(F.col("_gid") == 2, "region").otherwise("global").alias("level"),
        "carrier", "region", "late", "n", (F.col("late") / F.col("n")).alias("rate"))
    needs_carrier = F.col("level").isin("carrier", "carrier_region")
    needs_region = F.col("level").isin("region", "carrier_region")
    kept = named.where((~needs_carrier | F.col("carrier").isNotNull())
                       & (~needs_region | F.col("region").isNotNull()))
    if min_count:
        kept = kept.where((F.col("level") == "global") | (F.col("n") >= min_count))
    return kept


@dataclass(frozen=True)
class Rates:
    """A learnt rate table with its rows, measured bytes and hottest share per level, and the
    global rate."""

    table: DataFrame
    sizes: dict[str, int]
    global_rate: float | None
    bytes: dict[str, int]
    shares: dict[str, float]

    def apply(self, df: DataFrame, target: str | None = None, salt_by: str | None = None) -> DataFrame:
        """Add the three rate features; unseen or missing keys get the global rate.

        With ``target`` (leave-one-out, for training rows) the row's own outcome is
        taken out of its rates.
        """
        fallback = F.lit(C.DEFAULT_GLOBAL_RATE if self.global_rate is None else self.global_rate)
        out = df
        for level, (keys, feature) in LEVELS.items():
            part = (self.table.where(F.col("level") == level)
                    .select(*keys, F.col("late").alias("_late"), F.col("n").alias("_n"),
                            F.col("rate").alias("_rate")))
            joined = lookup(out, part, keys, self.bytes.get(level, 0), salt_by,
                            self.shares.get(level, HOTTEST_SHARE))
            rate: Column = F.col("_rate")
            if target is not None:
                rate = F.try_divide(F.col("_late") - F.col(target), F.nullif(F.col("_n") - 1, F.lit(0)))
            out = joined.withColumn(feature, F.coalesce(rate, fallback)).drop("_late", "_n", "_rate")
        return out

    def save(self, path: str) -> None:
        self.table.write.mode("errorifexists").parquet(path)


def fit_rates(train: DataFrame, min_count: int = 0) -> Rates:
    """Learn the rates once, fix them, and count them per level."""
    return _measured(pin(rate_table(train, min_count)))


def load_rates(spark: SparkSession, path: str) -> Rates:
    return _measured(spark.read.parquet(path))


def _measured(table: DataFrame) -> Rates:
    rows = table.groupBy("level").agg(
        F.count("*").alias("rows"), F.sum(row_bytes(table.dtypes)).alias("bytes"),
        (F.max("n") / F.greatest(F.sum("n"), F.lit(1))).alias("share"),
        F.max(F.when(F.col("level") == "global", F.col("rate"))).alias("rate")).collect()
    by_level = {row["level"]: row for row in rows}
    whole = by_level.get("global")
    return Rates(table, {level: row["rows"] for level, row in by_level.items()}, whole["rate"] if whole else None,
                 {level: row["bytes"] for level, row in by_level.items()},
                 {level: row["share"] or 0.0 for level, row in by_level.items()})


def empty_to_null(df: DataFrame) -> DataFrame:
    """Scoring rows: an empty carrier or region is a missing one."""
    return df.withColumns({name: F.nullif(F.col(name), F.lit("")) for name in ("carrier", "region")})
