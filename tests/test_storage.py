"""Quarantine of broken lines, and joins of bucketed tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwatch.operators import event_log, joins
from lagwatch.session import scratch_path
from lagwatch.sources import quarantine as qu
from lagwatch.sources.readers import spread
from workload import queries as Q

D = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("at", T.DateType())])


def test_every_line_is_in_one_part(spark):
    lines = ['{"id": 1, "name": "a", "at": "2024-01-02"}', '{"id": 2, "name": null}', '{"id": "x", "name": "b"}', '{"id": 3', "", "   ", None,
             "[]", "words", '{"name": "c"}', '{"id": 4, "other": 1}', '{"id": 1, "name": "a", "at": "2024-01-02"}']
    source = spark.createDataFrame([(x,) for x in lines], "value string")
    loaded = qu.load_lines(source, SCHEMA, required=["id"])
    assert sorted((r["id"], r["name"]) for r in loaded.rows.where("name IS NOT NULL").collect()) == [(1, "a"), (1, "a")]
    assert loaded.rows.count() + loaded.quarantine.count() == len(lines)
    counts = {r["reason"]: r["n"] for r in loaded.counts().collect()}
    assert counts[qu.EMPTY] == 3 and counts["missing: id"] == 1 and sum(counts.values()) == len(lines)
    kept = {r["value"] for r in loaded.quarantine.where("reason = 'unreadable'").collect()}
    assert kept == {'{"id": "x", "name": "b"}', '{"id": 3', "[]", "words"}


def test_csv_lines(spark):
    source = spark.createDataFrame([("1,a,2024-01-02",), ("x,b,2024-01-02",), ('2,"b, c",',), ("3,d,2024-01-02,more",), ("4,e,soon",)], "value string")
    loaded = qu.load_lines(source, SCHEMA, "csv")
    assert sorted((r["id"], r["name"]) for r in loaded.rows.collect()) == [(1, "a"), (2, "b, c")]
    assert sorted(r["value"][0] for r in loaded.quarantine.collect()) == ["3", "4", "x"]


def test_no_lines(spark):
    loaded = qu.load_lines(spark.createDataFrame([], "value string"), SCHEMA)
    assert loaded.rows.collect() == [] and loaded.quarantine.collect() == [] and loaded.counts().collect() == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_and_group_without_an_exchange(spark):
    heads, events = Q.bucketed_orders(spark, D)
    grouped = event_log.events_per_order(events)
    assert "Exchange" not in plan_of(grouped)
    joined = joins.join_events(heads, grouped.hint("merge"))
    assert "SortMergeJoin" in plan_of(joined) and "Exchange" not in plan_of(joined)
    assert joined.count() == heads.count()


def test_few_files_are_dealt_over_the_cores(spark):
    path = scratch_path(spark, "few")
    spark.range(100).coalesce(1).write.parquet(path)
    few = spread(spark.read.parquet(path))
    assert few.select(F.spark_partition_id()).distinct().count() > 1 and few.count() == 100
    spark.range(100).repartition(8).write.mode("append").parquet(path)
    many = spark.read.parquet(path)
    assert spread(many) is many
