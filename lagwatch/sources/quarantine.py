"""Text input that may be broken: every line ends up either among the rows or in quarantine."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Why a line is in quarantine, besides ``missing: <field>``.
UNREADABLE, EMPTY = "unreadable", "empty"


def judged_lines(lines: DataFrame, schema: T.StructType, kind: str = "json", required: Sequence[str] = (),
                 options: dict[str, str] | None = None) -> DataFrame:
    """``value, row, reason``: each line of text parsed by the schema, with the reason if it cannot be
    used, else NULL. A line that does not parse as a whole, or a value that does not fit its type, makes it unreadable;
    a ``required`` field must be there. Kinds are ``json`` and ``csv``."""
    if kind not in ("json", "csv"):
        raise ValueError("lines are json or csv")
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", **(options or {})}
    parsed = F.from_json("value", wide, how) if kind == "json" else F.from_csv("value", wide.simpleString()[7:-1].replace(":", " "), how)
    rows = lines.select("value", parsed.alias("_p"))
    missing = [F.when(F.col(f"_p.{c}").isNull(), F.lit(f"missing: {c}")) for c in required]
    blank = F.coalesce(F.trim("value"), F.lit("")) == ""
    reason = F.coalesce(F.when(blank, F.lit(EMPTY)), F.when(F.col("_p").isNull() | F.col("_p._corrupt").isNotNull(), F.lit(UNREADABLE)), *missing)
    return rows.select("value", F.struct(*[F.col(f"_p.{f.name}").alias(f.name) for f in schema.fields]).alias("row"), reason.alias("reason"))


@dataclass(frozen=True)
class Loaded:
    """``rows`` that can be used, and ``quarantine`` (``value, reason``) with the others."""

    rows: DataFrame
    quarantine: DataFrame

    def counts(self) -> DataFrame:
        """Lines per reason; NULL for those that are used."""
        good = self.rows.select(F.lit(None).cast("string").alias("reason")).groupBy("reason").count()
        return good.unionByName(self.quarantine.groupBy("reason").count()).withColumnRenamed("count", "n")


def load_lines(lines: DataFrame, schema: T.StructType, kind: str = "json", required: Sequence[str] = (),
               options: dict[str, str] | None = None, path: str | None = None) -> Loaded:
    """Parse lines once and store both parts below ``path`` (a new folder by default), so that neither
    reads the text again. An unusable line is stored as it came."""
    spark, path = lines.sparkSession, path or scratch_path(lines.sparkSession, "loaded")
    judged = judged_lines(lines, schema, kind, required, options)
    broken = F.col("reason").isNotNull()
    (judged.select(F.when(broken, F.col("value")).alias("value"), F.when(~broken, F.col("row")).alias("row"), "reason", broken.alias("broken"))
     .write.mode("errorifexists").partitionBy("broken").parquet(path))
    stored = spark.read.schema(T.StructType([
        T.StructField("value", T.StringType()), T.StructField("row", schema), T.StructField("reason", T.StringType()),
        T.StructField("broken", T.BooleanType())])).parquet(path)
    return Loaded(stored.where(~F.col("broken")).select("row.*"), stored.where("broken").select("value", "reason"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
