"""Streams with state: orders with each event counted once, sessions, predictions with their outcomes.

Events may come out of order and more than once. A time (watermark) that trails the latest event by
``late_by`` bounds all state: repeats of an event within it are dropped, and what is older is left
out, as Structured Streaming does. Events without an order or a time belong to no state. An
event without an id is known by its order, type and time.

Predictions that wait for outcomes are kept in RocksDB, on the disks of the executors and in a bounded part of
their memory: both sides of a stream are state, which outgrows a heap long before it outgrows a disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.event_log import sessions
from ..session import move, session_settings
from .jobs import _started, run_to_table

_ROCKSDB = "spark.sql.streaming.stateStore.rocksdb"
#: State of the join on disk, one store per partition for both sides. Rows are not counted on the way, which takes
#: a read per write; a batch without data would only drop state, which the next one with data does. Keys and rows are
#: kept once in the store and once in its log: both are packed with zstd.
_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    f"{_ROCKSDB}.compression": "zstd",
    f"{_ROCKSDB}.changelogCheckpointing.enabled": "true",
    f"{_ROCKSDB}.trackTotalNumberOfRows": "false",
    f"{_ROCKSDB}.boundedMemoryUsage": "true",
}

_STATE = "opened long, num_eventos long, first long, last long, last_id string, last_type string"
_LIVE = ("order_id string, opened long, num_eventos long, primer_evento_ts timestamp, ultimo_evento_ts timestamp, "
         "ultimo_id string, ultimo_tipo string, closed boolean")


def once(events: DataFrame, late_by: str) -> DataFrame:
    """A stream of events with a watermark, each event once."""
    known = F.coalesce(F.col("event_id").cast("string"), F.concat(
        F.lit("#"), F.xxhash64("order_id", "event_type", F.col("event_timestamp").cast("timestamp")).cast("string")))
    timed = events.where(F.col("order_id").isNotNull() & F.col("event_timestamp").isNotNull()).select(
        F.col("order_id").cast("string").alias("order_id"), "event_type",
        F.col("event_timestamp").cast("timestamp").alias("event_timestamp"), known.alias("event_id"),
        F.col("event_id").cast("long").alias("event_order"))
    return timed.withWatermark("event_timestamp", late_by).dropDuplicatesWithinWatermark(["event_id"])


def live_orders(events: DataFrame, late_by: str = "30 days", silent_days: float = 60.0) -> DataFrame:
    """The state of every order that a micro-batch touches, for update mode: the aggregates of its
    events so far. An order that has been silent for ``silent_days`` is closed and its state
    dropped; events that come after that open it anew, under another ``opened``.

    Of events at one time the one with the greatest id is the latest, ids compared as numbers.
    """
    silence = int(silent_days * 86_400_000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            opened, n, first, last, last_id, last_type = state.get
            state.remove()
            closed = True
        else:
            closed = False
            opened, n, first, last, last_id, last_type = state.get if state.exists else (state.getCurrentWatermarkMs(), 0, None, None, None, None)
            for part in parts:
                at = part["event_timestamp"].astype("datetime64[us]").astype("int64")
                ids = part["event_order"].fillna(-1).astype("int64")
                n += int(part["event_type"].notna().sum())
                first = int(at.min()) if first is None else min(first, int(at.min()))
                newest = pd.DataFrame({"at": at, "id": ids}).sort_values(["at", "id"]).index[-1]
                best = (int(at[newest]), int(ids[newest]))
                if last is None or best > (last, int(last_id)):
                    kind = part["event_type"][newest]
                    last, last_id, last_type = best[0], str(best[1]), None if pd.isna(kind) else kind
            state.update((opened, n, first, last, last_id, last_type))
            state.setTimeoutTimestamp(max(last // 1000 + silence, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({
            "order_id": [key[0]], "opened": [opened], "num_eventos": [n], "primer_evento_ts": pd.to_datetime([first], unit="us"),
            "ultimo_evento_ts": pd.to_datetime([last], unit="us"), "ultimo_id": [last_id], "ultimo_tipo": [last_type], "closed": [closed]})

    return once(events, late_by).groupBy("order_id").applyInPandasWithState(step, _LIVE, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def run_live_orders(events: DataFrame, table: str, checkpoint: str, late_by: str = "30 days", silent_days: float = 60.0,
                    trigger: dict | None = None) -> StreamingQuery:
    """Keep the states of orders in a table: each micro-batch writes those it changed under its own
    number, so a repeated batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return _started(live_orders(events, late_by, silent_days), checkpoint, trigger, write, mode="update")


def _newest(spark: SparkSession, table: str) -> DataFrame:
    """The last state written of each order and opening; a compaction stands for the batches it holds."""
    rows = spark.read.option("mergeSchema", "true").parquet(table)
    if "upto" in rows.columns:
        newest = rows.agg(F.max("upto")).first()[0]
        rows = rows.where((F.col("upto") == newest) | (F.col("upto").isNull() & (F.col("batch") > newest)))
    rest = [c for c in rows.columns if c not in ("order_id", "opened", "batch", "upto")]
    # a compaction is older than any batch that is read beside it
    return rows.groupBy("order_id", "opened").agg(F.max_by(F.struct(*rest), F.col("batch")).alias("s")).select("order_id", "opened", "s.*")


def order_states(spark: SparkSession, table: str) -> DataFrame:
    """Aggregates per order over everything its states have counted."""
    latest = F.struct("ultimo_evento_ts", F.col("ultimo_id").cast("long").alias("id"))
    return _newest(spark, table).groupBy("order_id").agg(
        F.sum("num_eventos").alias("num_eventos"), F.min("primer_evento_ts").alias("primer_evento_ts"),
        F.max("ultimo_evento_ts").alias("ultimo_evento_ts"), F.max_by("ultimo_tipo", latest).alias("ultimo_tipo"))


def compact_order_states(spark: SparkSession, table: str) -> None:
    """Write the newest states once more, in place of the batches they come from. Written aside and
    renamed when whole; the stream goes on meanwhile."""
    rows = spark.read.option("mergeSchema", "true").parquet(table)
    upto = rows.agg(F.max("batch")).first()[0]
    before = rows.agg(F.max("upto")).first()[0] if "upto" in rows.columns else None
    if upto is None or upto < 0 or upto == before:
        return
    aside = f"{table}/_compacting-{upto}"
    _newest(spark, table).withColumn("upto", F.lit(upto).cast("int")).write.mode("errorifexists").parquet(aside)
    move(spark, aside, f"{table}/batch={-1 - upto}")


def run_sessions(events: DataFrame, table: str, checkpoint: str, silence_hours: float = 72.0, late_by: str = "30 days",
                 trigger: dict | None = None) -> StreamingQuery:
    """Append the sessions of each order as they close: once the watermark has passed their last
    event and the silence after it."""
    return run_to_table(sessions(once(events, late_by), silence_hours, stream=True), table, checkpoint, trigger)


def completions(predictions: DataFrame, outcomes: DataFrame, within: str = "30 days", late_by: str = "7 days") -> DataFrame:
    """Predictions (``package_id``, ``timestamp``) with the outcomes (``package_id``, ``outcome``, ``outcome_at``) that come
    within the time bound after them. Either may come first. State is kept for the bound and ``late_by``."""
    made = predictions.select("package_id", F.col("timestamp").cast("timestamp").alias("predicted_at")).withWatermark("predicted_at", late_by)
    known = outcomes.select(F.col("package_id").alias("_package"), F.col("outcome").cast("int").alias("outcome"),
                            F.col("outcome_at").cast("timestamp").alias("outcome_at")).withWatermark("outcome_at", late_by)
    bound = (F.col("package_id") == F.col("_package")) & (F.col("outcome_at") >= F.col("predicted_at")) & (
        F.col("outcome_at") <= F.col("predicted_at") + F.expr(f"INTERVAL {within}"))
    return made.join(known, bound).select("package_id", "predicted_at", "outcome", "outcome_at")


def run_completions(predictions: DataFrame, outcomes: DataFrame, table: str, checkpoint: str, within: str = "30 days",
                    late_by: str = "7 days", trigger: dict | None = None) -> StreamingQuery:
    """Append completed predictions to a file table. A stream that began with other state goes on with that."""
    with session_settings(predictions.sparkSession, _ON_DISK):
        return run_to_table(completions(predictions, outcomes, within, late_by), table, checkpoint, trigger)


def completed_log(log: DataFrame, completed: DataFrame) -> DataFrame:
    """The prediction log with the outcomes completed so far. Of several for one prediction (repeats,
    corrections) the last counts; a prediction without one stays open."""
    key = [F.col("package_id"), F.col("timestamp").cast("timestamp").alias("predicted_at")]
    last = completed.groupBy("package_id", "predicted_at").agg(
        F.max_by("outcome", F.struct("outcome_at", "outcome")).alias("_outcome"))
    joined = log.withColumn("_at", key[1]).alias("l").join(
        last.alias("o"), (F.col("l.package_id") == F.col("o.package_id")) & (F.col("l._at") == F.col("o.predicted_at")), "left")
    return joined.select(*[F.coalesce("o._outcome", "l.actual_outcome").alias(c) if c == "actual_outcome" else F.col(f"l.{c}")
                           for c in log.columns])

