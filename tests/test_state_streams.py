"""Streams with state against the batch results: replays, repeats, disorder, expiry."""

import pytest
from pyspark.sql import functions as F

from lagwatch.operators.event_log import events_per_order, sessions
from lagwatch.session import scratch_path
from lagwatch.streaming import jobs, state
from workload import views as V

D = "/root/testdata/sf0.001"
EVENTS = "order_id string, event_type string, event_timestamp timestamp_ntz, event_id long"


def rows(df):
    kinds = {c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"}
    return sorted(map(repr, df.withColumns(kinds).select(sorted(df.columns)).collect()))


@pytest.fixture
def folder(spark):
    return scratch_path(spark, "in")


def land(spark, folder, data):
    """One file; later files are read later."""
    frame = data if hasattr(data, "write") else spark.createDataFrame(data, EVENTS)
    frame.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema=EVENTS):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def t(day, hour=0):
    from datetime import datetime, timedelta
    return datetime(2024, 1, 1) + timedelta(days=day, hours=hour)


def test_orders_with_replayed_files_and_repeated_events(spark, folder):
    events = V.event_log(spark, D).select("order_id", "event_type", "event_timestamp", "event_id")
    events = spark.createDataFrame(events.collect(), EVENTS)
    land(spark, folder, events.where("event_id % 2 = 0").orderBy(F.rand(1)))
    land(spark, folder, events.where("event_id % 2 = 0"))  # a replayed file
    land(spark, folder, events.where("event_id % 2 = 1").unionByName(events.where("event_id % 5 = 0")).orderBy(F.rand(2)))
    table, chk = scratch_path(spark, "live"), scratch_path(spark, "chk")
    state.run_live_orders(stream(spark, folder), table, chk, late_by="400 days").awaitTermination()
    want = rows(events_per_order(events))
    assert rows(state.order_states(spark, table)) == want
    state.compact_order_states(spark, table)
    state.compact_order_states(spark, table)
    assert rows(state.order_states(spark, table)) == want
    land(spark, folder, [("new", "packed", t(3), 10**9), ("new", "packed", t(3), 10**9)])
    state.run_live_orders(stream(spark, folder), table, chk, late_by="400 days").awaitTermination()
    assert rows(state.order_states(spark, table).where("order_id <> 'new'")) == want
    assert state.order_states(spark, table).where("order_id = 'new'").first()["num_eventos"] == 1


def test_silent_orders_expire_and_open_anew(spark, folder):
    table, chk = scratch_path(spark, "live"), scratch_path(spark, "chk")
    days = [[("a", "packed", t(0), 1), ("b", "confirmed", t(1), 2), (None, "packed", t(1), 3), ("c", "packed", None, 4)],
            [("b", "packed", t(30), 5), ("d", None, t(31), 6)],  # 'a' is silent by now
            [("b", "packed", t(32), 7)],
            [("a", "delivered", t(33), 8), ("a", "delivered", t(33), 8), ("a", "packed", t(33), 9)],
            [("late", "packed", t(2), 10)]]  # older than the watermark
    for data in days:
        land(spark, folder, data)
        state.run_live_orders(stream(spark, folder), table, chk, late_by="2 days", silent_days=10).awaitTermination()
    found = {r["order_id"]: (r["num_eventos"], r["ultimo_tipo"]) for r in state.order_states(spark, table).collect()}
    assert found == {"a": (3, "packed"), "b": (3, "packed"), "d": (0, None)}
    lives = state._newest(spark, table).where("order_id = 'a'").orderBy("opened").collect()
    assert [(r["num_eventos"], r["closed"]) for r in lives] == [(1, True), (2, False)]


SESSIONS = [("a", "x", t(0), 1), ("a", "x", t(0, 72), 2), ("a", "x", t(9), 3), ("a", "x", t(6, 0.5), 4), ("a", "x", t(13), 5),
            ("b", "x", t(1), 6), ("b", "x", t(1), 7), ("c", None, t(2), 8), ("a", "x", t(20), 9)]


def plain_sessions(data, hours):
    out = {}
    for order, _, at, _ in sorted((r for r in data if r[0] and r[2]), key=lambda r: (r[0], r[2])):
        runs = out.setdefault(order, [])
        if runs and (at - runs[-1][1]).total_seconds() <= hours * 3600:
            runs[-1][1:] = [at, runs[-1][2] + 1]
        else:
            runs.append([at, at, 1])
    return sorted((o, *s) for o, runs in out.items() for s in runs)


@pytest.mark.parametrize("hours", [72.0, 0.5, 96.0])
def test_sessions_of_a_batch(spark, hours):
    data = [*SESSIONS, (None, "x", t(3), 20), ("d", "x", None, 21)]
    found = sessions(spark.createDataFrame(data[::-1], EVENTS), hours).collect()
    assert sorted((r["order_id"], r["session_start"], r["session_end"], r["events"]) for r in found) == plain_sessions(data, hours)
    assert sessions(spark.createDataFrame([], EVENTS), hours).collect() == []


def test_sessions_of_a_stream(spark, folder):
    table, chk = scratch_path(spark, "sessions"), scratch_path(spark, "chk")
    for k in range(3):
        land(spark, folder, SESSIONS[k::3] + SESSIONS[:1])  # out of order, the first event three times
    land(spark, folder, [("z", "x", t(90), 100)])  # time goes on: all others close
    state.run_sessions(stream(spark, folder), table, chk, late_by="30 days").awaitTermination()
    found = spark.read.parquet(table).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")}).collect()
    assert sorted((r["order_id"], r["session_start"], r["session_end"], r["events"]) for r in found) == plain_sessions(SESSIONS, 72)


def test_outcomes_join_predictions_as_both_arrive(spark):
    made, known = scratch_path(spark, "made"), scratch_path(spark, "known")
    table, chk = scratch_path(spark, "completed"), scratch_path(spark, "chk")
    p = "package_id string, timestamp timestamp_ntz, actual_outcome int"
    o = "package_id string, outcome int, outcome_at timestamp_ntz"
    predictions = [[("a", t(0), None), ("b", t(0), None), ("c", t(1), 1)], [("d", t(5), None), ("a", t(6), None)], [("e", t(8), None)]]
    outcomes = [[("e", 1, t(9)), ("a", 0, t(3))], [("b", 1, t(40)), ("d", 1, t(6)), ("d", 1, t(6))], [("a", 1, t(7)), ("d", 0, t(7)), ("x", 1, t(1))]]
    for k in range(3):  # one outcome comes before its prediction
        spark.createDataFrame(predictions[k], p).coalesce(1).write.mode("append").parquet(made)
        spark.createDataFrame(outcomes[k], o).coalesce(1).write.mode("append").parquet(known)
        state.run_completions(spark.readStream.schema(p).parquet(made), spark.readStream.schema(o).parquet(known),
                              table, chk, "30 days", "60 days").awaitTermination()
    log = spark.read.parquet(made)
    found = sorted((r["package_id"], r["timestamp"], r["actual_outcome"]) for r in state.completed_log(log, spark.read.parquet(table)).collect())
    assert found == [("a", t(0), 1), ("a", t(6), 1), ("b", t(0), None), ("c", t(1), 1), ("d", t(5), 0), ("e", t(8), 1)]


def test_state_of_completions_is_on_disk_in_one_store_per_partition(spark, folder):
    """Kept on the heap, both sides of 60 times sf0.1 take more than three executors of 10 GB have."""
    made, known, table, chk = (f"{folder}/{n}" for n in ("made", "known", "completed", "chk"))
    n, kept = 500, spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    made_rows = spark.range(n).select(F.col("id").cast("string").alias("package_id"), at.alias("timestamp"), F.lit(None).cast("int").alias("actual_outcome"))
    outcomes = spark.range(0, n, 3).select(F.col("id").cast("string").alias("package_id"), (F.col("id") % 2).cast("int").alias("outcome"), at.alias("outcome_at"))
    made_rows.write.parquet(made)
    outcomes.write.parquet(known)
    query = state.run_completions(spark.readStream.schema(made_rows.schema).parquet(made),
                                  spark.readStream.schema(outcomes.schema).parquet(known), table, chk)
    query.awaitTermination()
    stores = [o for p in query.recentProgress for o in p["stateOperators"]]
    assert stores and all("rocksdbPutCount" in o["customMetrics"] for o in stores)
    assert all(o["numStateStoreInstances"] == o["numShufflePartitions"] for o in stores)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == kept  # other streams keep their own
    found = state.completed_log(spark.read.parquet(made), spark.read.parquet(table))
    assert found.agg(F.count("*"), F.count("actual_outcome"), F.sum("actual_outcome")).first() == (n, 167, 83)
