"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lagwatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs assume; ``conf`` wins over them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` decides. A folder of our own is made only where it
    is unset and the session is local, as in tests.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="lagwatch-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; never reused, so nothing is overwritten. All paths of
    an application have one parent, so that one folder can be dropped when it has ended."""
    return f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEANING: dict[str, tuple[int, str | None]] = {}
_CLEANING_LOCK = threading.Lock()


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Executions that begin meanwhile drop their shuffle files when they end. Several threads may be inside: the
    first sets the session, the last sets it back."""
    key = spark.sparkContext.applicationId
    with _CLEANING_LOCK:
        inside, before = _CLEANING.get(key, (0, None))
        if not inside:
            before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _CLEANING[key] = inside + 1, before
    try:
        yield
    finally:
        with _CLEANING_LOCK:
            inside, before = _CLEANING.pop(key)
            if inside > 1:
                _CLEANING[key] = inside - 1, before
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


def store(df: DataFrame, path: str, *partition_by: str, **options: str) -> None:
    """Write a step of a job as Parquet. It is packed with zstd, and what was shuffled for it goes when it is
    whole: else it stays on the disks until the driver happens to collect garbage, beside the steps that follow."""
    with _shuffles_dropped(df.sparkSession):
        df.write.partitionBy(*partition_by).options(**{"compression": "zstd", **options}).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Store a result as Parquet in the shared folder and read it back: readers see the same rows,
    read only the columns they need, and survive lost executors."""
    path = scratch_path(df.sparkSession, name)
    store(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin(df: DataFrame) -> DataFrame:
    """Fix a result in the shared folder, so that later readers see the same rows
    and the same partition numbers even after executors were lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def concurrently(spark: SparkSession, tasks: Sequence[Callable[[], object]]) -> list:
    """Run chains of Spark jobs side by side, each in a scheduler pool of its own, and return what
    they return, in order. When one fails, the jobs of the others are cancelled and its error is raised."""
    tag, sc = f"concurrent-{uuid.uuid4().hex}", spark.sparkContext

    def in_pool(number: int, task: Callable[[], object]) -> object:
        sc.addJobTag(tag)
        sc.setLocalProperty("spark.scheduler.pool", f"{tag}-{number}")
        return task()

    if not tasks:
        return []
    with ThreadPoolExecutor(len(tasks)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(in_pool), k, task) for k, task in enumerate(tasks)]
        done, _ = wait(started, return_when=FIRST_EXCEPTION)
        error = next((f.exception() for f in done if f.exception()), None)
        if error:
            for future in started:
                future.cancel()
            sc.cancelJobsWithTag(tag)
            raise error
        return [future.result() for future in started]


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while. A stream keeps those it was started under."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path and the path, as Spark itself reaches them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if another writer already has."""
    fs, where = _hadoop(spark, path)
    try:
        return fs.createNewFile(where)
    except Exception as error:  # some stores refuse instead of answering
        if "AlreadyExists" in str(error):
            return False
        raise


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a finished folder, so that readers see all of it or nothing."""
    fs, where = _hadoop(spark, source)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"{source} cannot be renamed to {target}")
