"""Impute, scale and encode features; learnt on the training split only."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..session import written
from .joins import HOTTEST_SHARE, lookup, row_bytes
from .order_stats import exact_medians, long_form, running_totals

INFREQUENT = "__infrequent__"
ENCODINGS = ("rate", "one_hot")


def numeric_stats(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: train median, and mean and population deviation after the gaps
    were filled with it. Features without any value are left out."""
    values = long_form(train, columns)
    present = F.col("value").isNotNull() & ~F.isnan("value")
    x = F.when(present, F.col("value"))
    moments = values.groupBy("feature").agg(
        F.count("*").alias("rows"), F.count(x).alias("n"),
        F.avg(x).alias("avg"), F.var_pop(x).alias("var"))
    medians = exact_medians(values, F.col("value"), ["feature"])
    joined = moments.alias("m").join(medians.alias("q"), F.col("m.feature") == F.col("q.feature"))
    gaps = (F.col("m.rows") - F.col("m.n")) / F.col("m.rows")
    filled = F.col("m.n") / F.col("m.rows")
    shift = F.col("q.median") - F.col("m.avg")
    # merge the known values with the filled ones, which all sit at the median
    mean = F.col("m.avg") + shift * gaps
    var = F.col("m.var") * filled + shift * shift * filled * gaps
    return joined.select(
        F.col("m.feature"), F.col("q.median"), mean.alias("mean"), F.sqrt(var).alias("std"))


def scaled(x: Column, median: float, mean: float, std: float) -> Column:
    """Fill with the train median, then standardise; zero spread divides by 1."""
    value = x.cast("double")
    value = F.when(F.isnan(value), None).otherwise(value)
    return (F.coalesce(value, F.lit(median)) - F.lit(mean)) / F.lit(std if std > 0 else 1.0)


def level_counts(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Train rows and late rows per category: ``feature, value, n, late``; NULL is a category."""
    values = long_form(train, columns, keep=[C.TARGET], kind="string")
    return values.groupBy("feature", F.coalesce("value", F.lit(C.UNKNOWN)).alias("value")).agg(
        F.count("*").alias("n"), F.sum(C.TARGET).alias("late"))


def pooled_level(min_count: int) -> Column:
    """The value itself, or the shared infrequent level below ``min_count``."""
    return F.when(F.col("n") >= min_count, F.col("value")).otherwise(INFREQUENT)


def category_levels(train: DataFrame, columns: Sequence[str],
                    min_count: int = C.MIN_CATEGORY_COUNT) -> DataFrame:
    """Train categories: ``feature, value, n, level``."""
    values = long_form(train, columns, kind="string")
    filled = F.coalesce("value", F.lit(C.UNKNOWN))
    counts = values.groupBy("feature", filled.alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("level", pooled_level(min_count))


def numbered_levels(counts: DataFrame, min_count: int = C.MIN_CATEGORY_COUNT) -> DataFrame:
    """``feature, value, n, level, slot, rate`` of each category.

    Frequent levels are numbered in the order of their names within the feature, by running
    totals over ranges, so no column's names are gathered; the rare ones share the slot behind
    them. The rate is the late rate of the level. What rare levels share is one row per
    feature, and is broadcast.
    """
    rare = counts.where(F.col("n") < min_count).groupBy("feature").agg(
        (F.sum("late") / F.sum("n")).alias("_rare_rate"))
    frequent = counts.where(F.col("n") >= min_count)
    slots = frequent.groupBy("feature").agg(F.count("*").alias("_slots"))
    ordered = running_totals(frequent.withColumn("_one", F.lit(1).cast("bigint")), [F.col("value")], ["_one"], ["feature"])
    kept = ordered.select("feature", "value", "n", F.col("value").alias("level"),
                          F.col("_one_before").cast("int").alias("slot"), (F.col("late") / F.col("n")).alias("rate"))
    pooled = (counts.where(F.col("n") < min_count)
              .join(F.broadcast(rare), "feature").join(F.broadcast(slots), "feature", "left")
              .select("feature", "value", "n", F.lit(INFREQUENT).alias("level"),
                      F.coalesce("_slots", F.lit(0)).cast("int").alias("slot"), F.col("_rare_rate").alias("rate")))
    return kept.unionByName(pooled)


@dataclass(frozen=True)
class Preparer:
    """Learnt preparation. ``levels`` has ``feature, value, n, level, slot, rate``; on the driver
    are only numbers per column: its slots, measured bytes and hottest share."""

    numeric: dict[str, tuple[float, float, float]]
    slots: dict[str, int]
    boolean: list[str]
    levels: DataFrame
    sizes: dict[str, int]
    shares: dict[str, float]
    late_rate: float = C.DEFAULT_GLOBAL_RATE

    @property
    def width(self) -> int:
        """Entries of the one-hot vector."""
        return len(self.numeric) + sum(self.slots.values()) + len(self.boolean)

    @property
    def raw_features(self) -> list[str]:
        return [*self.numeric, *self.slots, *self.boolean]

    def offsets(self) -> dict[str, int]:
        """Place of each column's first entry in the one-hot vector."""
        place, out = 0, {}
        for name in self.raw_features:
            out[name] = place
            place += self.slots.get(name, 1)
        return out

    def slot_names(self) -> DataFrame:
        """``position, name`` of every entry of the one-hot vector, as a table."""
        spark, places = self.levels.sparkSession, self.offsets()
        single = [(places[c], f"num__{c}") for c in self.numeric] + [(places[c], f"bool__{c}") for c in self.boolean]
        named = spark.createDataFrame(single, "position int, name string")
        base = F.lit(None).cast("int")
        for column in self.slots:
            base = F.when(F.col("feature") == column, F.lit(places[column])).otherwise(base)
        levels = self.levels.select("feature", "level", "slot").distinct()
        return named.unionByName(levels.select((base + F.col("slot")).alias("position"),
                                               F.concat(F.lit("cat__"), "feature", F.lit("_"), "level").alias("name")))

    def encode(self, df: DataFrame, salt_by: str | None = None) -> DataFrame:
        """Add, per column, its encoded value: ``_n_`` scaled number, ``_s_`` slot and ``_r_`` late
        rate of the category, ``_b_`` flag. A category not seen in training has the slot behind
        the last one, and the overall late rate."""
        out = df
        for column, slots in self.slots.items():
            part = (self.levels.where(F.col("feature") == column)
                    .select(F.col("value").alias(f"_v_{column}"), F.col("slot").alias(f"_s_{column}"),
                            F.col("rate").alias(f"_r_{column}")))
            out = lookup(
                out.withColumn(f"_v_{column}", F.coalesce(F.col(column).cast("string"), F.lit(C.UNKNOWN))),
                part, [f"_v_{column}"], self.sizes.get(column, 0), salt_by,
                self.shares.get(column, HOTTEST_SHARE)).drop(f"_v_{column}")
            # the slot count is stated in the metadata, so the encoder needs no pass of its own
            attribute = {"ml_attr": {"type": "nominal", "num_vals": slots + 1}}
            slot = F.coalesce(F.col(f"_s_{column}"), F.lit(slots)).cast("double")
            out = out.withColumn(f"_s_{column}", slot.alias(f"_s_{column}", metadata=attribute))
            out = out.withColumn(f"_r_{column}", F.coalesce(F.col(f"_r_{column}"), F.lit(self.late_rate)))
        return out.withColumns({
            **{f"_n_{c}": scaled(F.col(c), *stats) for c, stats in self.numeric.items()},
            **{f"_b_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.boolean},
        })

    def encoded_names(self, encoding: str = "rate") -> list[str]:
        kind = "_o_" if encoding == "one_hot" else "_r_"
        return [*[f"_n_{c}" for c in self.numeric], *[f"{kind}{c}" for c in self.slots], *[f"_b_{c}" for c in self.boolean]]

    def transform(self, df: DataFrame, output: str = "features", salt_by: str | None = None,
                  encoding: str = "rate") -> DataFrame:
        """Add the feature vector, with one encoding for every category, whatever its levels.

        ``rate`` gives each category as the training late rate of its level: one entry per raw
        feature, and the order in which a tree tries the categories of a binary outcome.
        ``one_hot`` gives one entry per frequent level and one for the rare ones; a category not
        seen in training is all zeros.
        """
        if encoding not in ENCODINGS:
            raise ValueError(f"encoding is one of {', '.join(ENCODINGS)}")
        out = self.encode(df, salt_by)
        if encoding == "one_hot" and self.slots:
            out = OneHotEncoder(inputCols=[f"_s_{c}" for c in self.slots], outputCols=[f"_o_{c}" for c in self.slots],
                                dropLast=True).fit(out).transform(out)
        vector = VectorAssembler(inputCols=self.encoded_names(encoding), outputCol=output).transform(out)
        return vector.select(*df.columns, output)

    def save(self, path: str) -> None:
        spark = self.levels.sparkSession
        self.levels.write.mode("errorifexists").parquet(f"{path}/levels")
        params = {"numeric": self.numeric, "slots": self.slots, "boolean": self.boolean, "sizes": self.sizes,
                  "shares": self.shares, "late_rate": self.late_rate}
        spark.createDataFrame([(json.dumps(params),)], "params string").coalesce(1) \
            .write.mode("errorifexists").text(f"{path}/params")


def vector_entries(column: str) -> Column:
    """Entries of a feature vector as ``(slot, value)`` structs: those a sparse vector states, whatever its
    width, and all of a dense one."""
    v = F.unwrap_udt(F.col(column))
    place = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))
    return F.when(F.size(v["values"]) > 0, F.arrays_zip(place.alias("slot"), v["values"].alias("value")))


def vector_width(column: str) -> Column:
    """Entries of a feature vector, zeros included."""
    v = F.unwrap_udt(F.col(column))
    return F.coalesce(v["size"], F.size(v["values"]))


def load_preparer(spark: SparkSession, path: str) -> Preparer:
    params = json.loads(spark.read.text(f"{path}/params").first()[0])
    return Preparer({k: tuple(v) for k, v in params["numeric"].items()}, params["slots"], params["boolean"],
                    spark.read.parquet(f"{path}/levels"), params["sizes"], params["shares"], params["late_rate"])


def fit_preparer(train: DataFrame, features: Sequence[str],
                 min_count: int = C.MIN_CATEGORY_COUNT) -> Preparer:
    """Learn medians, scales and category slots from the training rows.

    What comes to the driver is one row per feature; categories stay in the level table.
    """
    numeric_columns = [c for c in features
                       if c in C.NUMERIC_FEATURES + C.EVENT_FEATURES + C.RATE_FEATURES]
    categorical_columns = [c for c in features if c in C.CATEGORICAL_FEATURES]
    boolean = [c for c in features if c in C.BOOLEAN_FEATURES]

    stats = {}
    if numeric_columns:
        stats = {r["feature"]: (r["median"], r["mean"], r["std"])
                 for r in numeric_stats(train, numeric_columns).collect()}
    numeric = {c: stats[c] for c in numeric_columns if c in stats}

    spark = train.sparkSession
    if not categorical_columns:
        none = spark.createDataFrame([], "feature string, value string, n bigint, level string, slot int, rate double")
        return Preparer(numeric, {}, boolean, none, {}, {})
    levels = written(numbered_levels(written(level_counts(train, categorical_columns), "counts"), min_count), "levels")
    per_column = {r["feature"]: r for r in levels.groupBy("feature").agg(
        (F.max("slot") + 1).alias("slots"), F.sum(row_bytes(levels.dtypes)).alias("bytes"),
        (F.max("n") / F.sum("n")).alias("share"),
        F.sum(F.col("rate") * F.col("n")).alias("late"), F.sum("n").alias("n")).collect()}
    # the overall late rate follows from the levels of any one column
    first = next(iter(per_column.values()), None)
    late_rate = first["late"] / first["n"] if first and first["late"] is not None else C.DEFAULT_GLOBAL_RATE
    return Preparer(numeric, {c: per_column[c]["slots"] if c in per_column else 0 for c in categorical_columns}, boolean, levels,
                    {c: r["bytes"] for c, r in per_column.items()}, {c: r["share"] for c, r in per_column.items()}, late_rate)
