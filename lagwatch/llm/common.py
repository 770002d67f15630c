"""What the text operators share: columns, row keys, staged tables and let-bindings.

A document is a row with ``doc_id`` (long) and ``text`` (string). Other columns pass
through or are ignored, as each operator says; one that has the name of a result gives way to
it. Internal columns start with ``__``.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwatch.session import scratch_path

# The white space that separates words, and the letters that are folded.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows up to which a two-column table of hashes is broadcast (some 10 MB); beyond it, a salted join.
BROADCAST_ROWS = 200_000
SALTS = 16


def small_batches(spark: SparkSession) -> None:
    """Texts are long rows: unless the session sets another number, two thousand of them go to a
    Python worker at a time, not ten thousand."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "2000")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The table; Python workers started from here on find this package as the driver does."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    small_batches(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns an operator reads, so that no other name can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def with_row_key(docs: DataFrame) -> DataFrame:
    """Add ``__i`` and ``__h``. Rows equal in both have the same id and text, so anything
    derived from the text is the same for them; a null id is told apart by its text."""
    return docs.withColumns({
        "__i": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)),
        "__h": F.xxhash64(F.col("text").isNull(), F.coalesce("text", F.lit("")))})


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to a new path of the shared folder and read back: the lineage ends there, and
    lost executors take nothing with them."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value computed once per row however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_ascii(text: Column) -> Column:
    """A-Z as a-z. For texts of one byte a character, ``lower`` does just that, and faster."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Words of a text without nulls; none for white space alone."""
    return F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")


def semi_join_hashes(rows: DataFrame, wanted: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Rows whose ``keys`` are in ``wanted`` (distinct). A counted small table is broadcast;
    a larger one is repeated under each salt, so that a hot key is dealt over many tasks."""
    if wanted.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(wanted), keys, "left_semi")
    salted = wanted.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
            .join(salted, [*keys, "__salt"], "left_semi").drop("__salt"))


_HELD: tuple[object, object] = (None, None)


def held(key: object, make: Callable[[], object]) -> object:
    """What a worker process remembers between tasks, for one operator at a time: as soon as
    another asks, the memory of the one before goes. Worker processes outlive the stages of a
    pipeline, and their memories would add up."""
    global _HELD
    if _HELD[0] != key:
        _HELD = (None, None)  # let go before the next is made
        _HELD = (key, make())
    return _HELD[1]
