"""Sinks: dataset, rates, metrics, model registry, monitor reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.training import RiskModel, load_model
from ..session import claim


def write_dataset(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """The dataset, partitioned by split where it has one, so a split is read alone.

    Rows are not moved to make the files: each task writes its share.
    """
    writer = df.write.mode("errorifexists").format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    if "split" in df.columns:
        writer = writer.partitionBy("split")
    writer.save(path)


#: Bytes of rows in a bucket of a stored table.
BUCKET_BYTES = 256 << 20


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], path: str, buckets: int) -> DataFrame:
    """A catalog table whose rows are dealt into sorted buckets by ``keys`` once, when they are written. Tables
    with the same keys, types and number of buckets are then joined and grouped by these keys without an
    exchange. ``buckets`` by the size to come, some ``BUCKET_BYTES`` each."""
    # every bucket is written by one task, else each task would write a file for each bucket
    dealt = df.repartition(buckets, *keys)
    (dealt.write.mode("errorifexists").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
    return df.sparkSession.table(name)


def store_run(df: DataFrame, path: str, run: str, part: str) -> None:
    """Add to a table of results (metrics, importance, reports, prediction log) under a run and a
    part; a run that is repeated replaces its own rows."""
    keyed = df.withColumns({"run": F.lit(run), "part": F.lit(part)})
    (keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "part").parquet(path))


def append_metrics(metrics: DataFrame, path: str, run: str, part: str) -> None:
    """Metrics as long rows keyed by run and part, for numeric columns."""
    names = [f.name for f in metrics.schema.fields
             if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "boolean")]
    pairs = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)
    label = F.col("name") if "name" in metrics.columns else F.lit(None).cast("string")
    rows = metrics.select(label.alias("threshold_name"), F.expr(f"stack({len(names)}, {pairs}) AS (metric, value)"))
    store_run(rows, path, run, part)


def stored_metric(spark: SparkSession, path: str, part: str, metric: str) -> float | None:
    """The value of a metric in the latest run that has it; None before the first run."""
    try:
        rows = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return rows.where((F.col("part") == part) & (F.col("metric") == metric)).agg(
        F.max_by("value", F.col("run").cast("string"))).first()[0]


def version_name(number: int, on: date) -> str:
    return f"v{number}_{on.isoformat()}"


class ModelRegistry:
    """Models by version below one folder, with a table of what was saved."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def _table(self) -> str:
        return f"{self.root}/registry"

    def versions(self) -> DataFrame:
        schema = "number int, version string, features int, saved_on date"
        try:
            return self.spark.read.schema(schema).parquet(self._table)
        except Exception as error:  # an empty registry is no error
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], schema)
            raise

    def latest(self) -> str | None:
        return self.versions().agg(F.max_by("version", "number")).first()[0]

    def save(self, model: RiskModel, on: date, version: str | None = None) -> str:
        """Save under ``v{n}_{date}`` unless a version is given; returns the version."""
        number = (self.versions().agg(F.max("number")).first()[0] or 0) + 1
        while not claim(self.spark, f"{self.root}/claims/{number}"):  # two writers never share a number
            number += 1
        version = version or version_name(number, on)
        model.save(f"{self.root}/{version}")
        row = (number, version, model.preparer.width, on)
        self.spark.createDataFrame([row], "number int, version string, features int, saved_on date") \
            .write.mode("append").parquet(self._table)
        return version

    def load(self, version: str | None = None) -> RiskModel:
        version = version or self.latest()
        if version is None:
            raise LookupError(f"no model below {self.root}")
        return load_model(self.spark, f"{self.root}/{version}", version)
