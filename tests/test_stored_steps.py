"""Stored steps: what they keep on disk, and what they leave behind."""

import glob
import threading
import time

from pyspark.sql import functions as F

from lagwatch import session
from lagwatch.operators import temporal_split as ts
from lagwatch.streaming import state
from workload import queries as Q
from workload import stage
from workload import views as V

D = "/root/testdata/sf0.001"
SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    """Shuffle files on disk, by shuffle number."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {int(n.split("_")[1]) for n in names if n.startswith("shuffle_")}


def test_a_stored_step_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    kept = session.written(rows, "test")
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.5)
    assert not left
    assert sorted(r["k"] for r in kept.collect()) == list(range(7))
    assert spark.conf.get(SETTING, None) in (None, "false")


def test_steps_are_packed_with_zstd(spark, tmp_path):
    path = str(tmp_path / "step")
    session.store(spark.range(10).withColumn("b", F.col("id") % 2), path, "b")
    assert glob.glob(f"{path}/b=1/*.zstd.parquet")
    assert spark.read.parquet(path).count() == 10


def test_the_setting_is_kept_while_any_thread_stores(spark):
    spark.conf.set(SETTING, "false")
    seen, inside, go_on = [], threading.Event(), threading.Event()

    def other():
        with session._shuffles_dropped(spark):
            inside.set()
            go_on.wait(20)

    try:
        one = threading.Thread(target=other)
        one.start()
        inside.wait(20)
        with session._shuffles_dropped(spark):
            seen.append(spark.conf.get(SETTING))
        seen.append(spark.conf.get(SETTING))
        go_on.set()
        one.join(20)
        seen.append(spark.conf.get(SETTING))
    finally:
        go_on.set()
        spark.conf.unset(SETTING)
    assert seen == ["true", "true", "false"]


def test_joined_rows_repeat_no_unread_columns(spark):
    assert not set(Q.UNREAD) & set(Q.joined(spark, D).columns)


def test_the_split_of_the_joined_rows_is_not_stored_again(spark):
    split = Q.joined_split(spark, D)
    assert not stage.staged_before(spark, D, "joined_split")
    expected = ts.temporal_split(Q.joined(spark, D))
    key = ["package_id", "split"]
    assert sorted(split.select(*key).collect()) == sorted(expected.select(*key).collect())


def test_state_that_waits_for_outcomes_is_packed_with_zstd(spark, tmp_path):
    made, known, table, checkpoint = (str(tmp_path / n) for n in ("made", "known", "table", "checkpoint"))
    log, came = V.prediction_log(spark, D).limit(50), V.outcomes(spark, D).limit(50)
    log.write.parquet(made)
    came.write.parquet(known)
    state.run_completions(spark.readStream.schema(log.schema).parquet(made), spark.readStream.schema(came.schema).parquet(known),
                          table, checkpoint, "20 days").awaitTermination()
    with open(f"{checkpoint}/offsets/0") as offsets:
        assert '"spark.sql.streaming.stateStore.compression.codec":"zstd"' in offsets.read()
