"""Steps whose cost must follow the rows, not the groups or the width of a vector."""

import contextlib
import io

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lagwatch.operators import joins
from lagwatch.operators import preparation as prep
from lagwatch.operators import sketches as sk
from lagwatch.sources.readers import spread
from workload import views as V


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain()
    return said.getvalue()


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_rows_are_not_gathered_by_group_for_rank_errors(spark, no_broadcast):
    rows = spark.range(1000).selectExpr("CASE WHEN id % 10 > 0 THEN 'a' ELSE 'b' END AS g", "CAST(id AS DOUBLE) AS v", "DATE'2024-01-01' AS day")
    found = sk.merged_quantiles(sk.day_quantiles(rows, F.col("day"), "v", ["g"]), [0.25, 0.5], ["g"])
    errors = sk.rank_errors(found, rows, "v", ["g"])
    assert "SortMergeJoin" not in plan(errors) and "SortAggregate" not in plan(errors)
    got = {(r["g"], r["prob"]): (r["n"], r["rank_error"]) for r in errors.collect()}
    assert {k: v[0] for k, v in got.items()} == {("a", 0.25): 900, ("a", 0.5): 900, ("b", 0.25): 100, ("b", 0.5): 100}
    assert max(v[1] for v in got.values()) <= 2 * sk.rank_error()


def test_no_quantiles_no_rank_errors(spark):
    rows = spark.createDataFrame([], "g string, v double, day date")
    found = sk.merged_quantiles(sk.day_quantiles(rows, F.col("day"), "v", ["g"]), [0.5], ["g"])
    assert sk.rank_errors(found, rows, "v", ["g"]).collect() == []


def test_lines_move_once_for_orders_and_customers(spark, no_broadcast):
    moved = [line for line in plan(V.derive_packages(spark, "/root/testdata/sf0.001")).splitlines() if "Exchange" in line]
    # dealt by order, then by supplier and by part; never round robin and never by customer
    assert sum("hashpartitioning(l_" in line for line in moved) == 3
    assert not any("RoundRobin" in line for line in moved)


def test_spread_by_a_key_keeps_the_rows(spark, tmp_path):
    path = str(tmp_path / "few")
    spark.range(100).selectExpr("CASE WHEN id % 7 > 0 THEN id % 5 END AS k", "id").coalesce(1).write.parquet(path)
    dealt = spread(spark.read.parquet(path), "k")
    assert sorted(r["id"] for r in dealt.collect()) == list(range(100))


def test_the_time_of_an_operation_is_made_once_for_its_parts(spark):
    assert plan(V.derive_itineraries(spark, "/root/testdata/sf0.001")).count("make_dt_interval") < 20


def test_entries_of_a_vector_are_those_it_states(spark):
    rows = spark.createDataFrame([
        (1, Vectors.sparse(50_000_000, [3, 49_999_999], [2.0, 0.5])), (2, Vectors.dense([0.0, 4.0])),
        (3, Vectors.sparse(5, [], [])), (4, None)], ["id", "features"])
    got = rows.select("id", F.explode(prep.vector_entries("features")).alias("e")).select("id", "e.slot", "e.value").collect()
    assert sorted(map(tuple, got)) == [(1, 3, 2.0), (1, 49_999_999, 0.5), (2, 0, 0.0), (2, 1, 4.0)]
    assert [r[0] for r in rows.orderBy("id").select(prep.vector_width("features")).collect()] == [50_000_000, 2, 5, None]


@pytest.mark.parametrize("share", [0.0, 0.9])
def test_a_lookup_beyond_the_bound_is_not_sent_through_the_driver(spark, tmp_path, monkeypatch, share):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 1000)
    path = str(tmp_path / "table")
    spark.range(50).selectExpr("CONCAT('k', id) AS k", "id AS n").write.parquet(path)  # far below the planner's own limit
    table = spark.read.parquet(path)
    facts = spark.range(300).selectExpr("CASE WHEN id % 3 > 0 THEN CONCAT('k', id % 60) END AS k", "id")
    size = joins.table_bytes(table)
    found = joins.lookup(facts, table, ["k"], size, share=share)
    assert size > 1000 and "Broadcast" not in plan(found)
    near = joins.lookup(facts, table, ["k"], 1000, share=share)
    assert "Broadcast" in plan(near)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, near.collect()), key=str)
