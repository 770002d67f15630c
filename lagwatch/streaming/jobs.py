"""Structured Streaming jobs over files: event state, prediction trend, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import constants as C
from ..operators.event_log import merge_per_order, partial_per_order
from ..plans.scoring import score_queries
from ..plans.training import RiskModel
from ..schemas import SCORING_QUERY
from ..session import move


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, kind: str = "parquet",
                pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(kind).load(folder)


def _started(stream: DataFrame, checkpoint: str, trigger: dict | None, write, mode: str = "append") -> StreamingQuery:
    """Start a stream of micro-batches; without a trigger the present input is used up."""
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start())


def run_event_state(events: DataFrame, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the per-order event aggregates of a stream as mergeable partial rows.

    Each micro-batch is reduced per order and written under its own batch number, so
    a repeated batch replaces itself. No state is held by the query: an order that is
    never closed costs nothing, and :func:`event_state` merges the parts when read.
    """
    def write(batch: DataFrame, number: int) -> None:
        partial_per_order(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return _started(events, checkpoint, trigger, write)


def _parts(spark: SparkSession, table: str) -> DataFrame:
    """The parts that count: the newest compaction, and the batches after those it holds.

    A compaction names in ``upto`` the last batch it merged. Batches that it holds are left out
    by number, so a reader sees each batch once, before, during and after a compaction.
    """
    rows = spark.read.option("mergeSchema", "true").parquet(table)
    if "upto" not in rows.columns:
        return rows
    newest = rows.agg(F.max("upto")).first()[0]
    return rows.where((F.col("upto") == newest) | (F.col("upto").isNull() & (F.col("batch") > newest)))


def event_state(spark: SparkSession, table: str) -> DataFrame:
    """Per-order aggregates of everything a stream has written so far."""
    return merge_per_order(_parts(spark, table))


def compact_event_state(spark: SparkSession, table: str) -> None:
    """Merge the closed batches in the table the stream goes on writing to.

    The merged rows are one more part of the same table, under a negative batch number. They are
    written aside and renamed when they are whole; the batches they hold are then left out by number.
    """
    parts = _parts(spark, table)
    upto = parts.agg(F.max(F.col("batch"))).first()[0]
    before = parts.agg(F.max("upto")).first()[0] if "upto" in parts.columns else None
    if upto is None or upto < 0 or upto == before:
        return
    parts.groupBy("order_id").agg(
        F.sum("num_eventos").cast("bigint").alias("num_eventos"),
        F.min("primer_evento_ts").alias("primer_evento_ts"),
        F.max("ultimo_evento_ts").alias("ultimo_evento_ts"),
        F.max("latest").alias("latest"),
        F.lit(upto).cast("int").alias("upto")).write.mode("errorifexists").parquet(f"{table}/_compacting-{upto}")
    move(spark, f"{table}/_compacting-{upto}", f"{table}/batch={-1 - upto}")


def day_totals(log: DataFrame) -> DataFrame:
    """Mergeable totals per day of a prediction log."""
    flagged = F.col("risk_score") >= C.ACTIVE_THRESHOLD
    late = F.col("actual_outcome") == 1
    return log.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("n"), F.count("actual_outcome").alias("labelled"),
        F.count_if(late).alias("late"), F.count_if(late & flagged).alias("caught"))


def run_day_totals(log: DataFrame, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep day totals of a prediction stream as mergeable parts, one per micro-batch. Late rows
    count whenever they come, and no window has to wait for a watermark to be seen."""
    def write(batch: DataFrame, number: int) -> None:
        day_totals(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return _started(log, checkpoint, trigger, write)


def sliding_state(spark: SparkSession, table: str, days: int = C.WINDOW_DAYS) -> DataFrame:
    """All windows of ``days`` over the day totals written so far, the open ones included."""
    names = ("n", "labelled", "late", "caught")
    per_day = spark.read.parquet(table).groupBy("day").agg(*[F.sum(m).alias(m) for m in names])
    windows = per_day.withColumn("window_start", F.explode(F.sequence(F.date_sub("day", days - 1), F.col("day"))))
    return windows.groupBy("window_start").agg(*[F.sum(m).cast("bigint").alias(m) for m in names])


def sliding_metrics(log: DataFrame, days: int = C.WINDOW_DAYS, late_by: str = "1 day") -> DataFrame:
    """Windows of ``days`` moving by one day over a prediction stream.

    Rows are first reduced to single days; the sliding step only repeats those.
    In append mode a window appears once it can no longer change.
    """
    flagged = F.col("risk_score") >= C.ACTIVE_THRESHOLD
    late = F.col("actual_outcome") == 1
    timed = log.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late_by)
    per_day = timed.groupBy(F.window("timestamp", "1 day").alias("day")).agg(
        F.count("*").alias("n"), F.count("actual_outcome").alias("labelled"),
        F.count_if(late).alias("late"), F.count_if(late & flagged).alias("caught"))
    sliding = per_day.groupBy(F.window(F.window_time("day"), f"{days} days", "1 day").alias("w"))
    return sliding.agg(*[F.sum(m).cast("bigint").alias(m) for m in ("n", "labelled", "late", "caught")]) \
        .select(F.to_date("w.start").alias("window_start"), "n", "labelled", "late", "caught")


def run_to_table(stream: DataFrame, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to a file table."""
    return (stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start(table))


def run_scoring(spark: SparkSession, folder: str, table: str, checkpoint: str, model: RiskModel,
                as_of: str, typical: dict[str, object] | None = None,
                pattern: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Score query files as they land; a repeated batch replaces its own output."""
    queries = file_stream(spark, folder, SCORING_QUERY, "json", pattern)
    at = F.lit(as_of).cast("timestamp_ntz")

    def write(batch: DataFrame, number: int) -> None:
        score_queries(batch, model, at, typical=typical).write.mode("overwrite").parquet(
            f"{table}/batch={number}")

    return _started(queries, checkpoint, trigger, write)
