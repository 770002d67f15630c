"""Streams give what a batch gives, over several micro-batches."""

from pyspark.sql import functions as F

from lagwatch.operators.drift import daily_trend
from lagwatch.operators.event_log import events_per_order
from lagwatch.session import scratch_path
from lagwatch.streaming import jobs
from workload import views as V

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_event_state_over_many_batches_and_compaction(spark):
    folder = scratch_path(spark, "events")
    raw = V.table(spark, D, "events")
    raw.repartition(5).write.parquet(folder)
    stream = V.map_events(jobs.file_stream(spark, folder, raw.schema, files_per_batch=2))
    table = scratch_path(spark, "state")
    jobs.run_event_state(stream, table, scratch_path(spark, "chk")).awaitTermination()
    batch = events_per_order(V.event_log(spark, D))
    assert spark.read.parquet(table).select("batch").distinct().count() > 1
    assert rows(jobs.event_state(spark, table)) == rows(batch)


def test_compaction_between_two_batches(spark):
    folder, table, chk = (scratch_path(spark, n) for n in ("events", "state", "chk"))
    raw = V.table(spark, D, "events")
    early, late = raw.where("event_id % 3 > 0"), raw.where("event_id % 3 = 0")
    early.repartition(3).write.parquet(folder)
    stream = V.map_events(jobs.file_stream(spark, folder, raw.schema, files_per_batch=1))
    jobs.run_event_state(stream, table, chk).awaitTermination()
    jobs.compact_event_state(spark, table)
    jobs.compact_event_state(spark, table)  # nothing new: no change
    assert rows(jobs.event_state(spark, table)) == rows(events_per_order(V.map_events(early)))
    late.repartition(2).write.mode("append").parquet(folder)
    jobs.run_event_state(stream, table, chk, trigger={"processingTime": "1 second"}).processAllAvailable()
    for query in spark.streams.active:
        query.stop()
    assert rows(jobs.event_state(spark, table)) == rows(events_per_order(V.event_log(spark, D)))
    jobs.compact_event_state(spark, table)
    assert rows(jobs.event_state(spark, table)) == rows(events_per_order(V.event_log(spark, D)))


def test_every_window_comes_out(spark):
    log = V.prediction_log(spark, D)
    folder, table = scratch_path(spark, "log"), scratch_path(spark, "days")
    log.repartition(4).write.parquet(folder)
    stream = jobs.file_stream(spark, folder, log.schema, files_per_batch=1)
    jobs.run_day_totals(stream, table, scratch_path(spark, "chk")).awaitTermination()
    assert rows(jobs.sliding_state(spark, table)) == rows(daily_trend(log))
