"""Joins whose physical form follows the measured size of a side."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a measured lookup table is broadcast.
BROADCAST_BYTES = 16 << 20
#: Rows up to which a table of a few numbers is broadcast; some 16 MB.
BROADCAST_ROWS = 200_000
#: Part of the facts that one key may hold, where nothing better is known.
HOTTEST_SHARE = 1 / 3


def on_keys(keys: Sequence[str], left: str = "l", right: str = "r") -> Column:
    test = F.lit(True)
    for key in keys:
        test = test & (F.col(f"{left}.{key}") == F.col(f"{right}.{key}"))
    return test


def row_bytes(columns: Sequence[tuple[str, str]]) -> Column:
    """About what a row of these (name, type) columns takes when it is broadcast."""
    total = F.lit(32 + 8 * len(columns)).cast("bigint")
    for name, kind in columns:
        if kind == "string":
            total = total + F.coalesce(F.octet_length(name), F.lit(0))
    return total


def table_bytes(table: DataFrame) -> int:
    """Measured size of a lookup table, from one aggregate."""
    return table.agg(F.sum(row_bytes(table.dtypes))).first()[0] or 0


def salts(facts: DataFrame, share: float) -> int:
    """Tasks over which the rows of one key are dealt, so that a key with ``share`` of the facts
    gives a task no more than an even deal would."""
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(min(1.0, max(0.0, share)) * parts))


def lookup(facts: DataFrame, table: DataFrame, keys: Sequence[str], size: int | None = None,
           salt_by: str | None = None, share: float = HOTTEST_SHARE) -> DataFrame:
    """Left join of facts to a lookup table that is unique on ``keys``.

    ``size`` is the table's measured size in bytes; without it the table is measured here, but for
    keys that few facts share (``share`` 0). Up to ``BROADCAST_BYTES`` it is broadcast. A larger table is joined by shuffle: facts without a
    key, which match nothing, stay where they are; the others of one key are spread over as many
    tasks as the ``share`` of the hottest key asks for, by ``salt_by`` or by all their columns, and
    the table is repeated for each. The planner knows a stored table by its compressed bytes, far
    fewer than these, and would still send it through the driver: a measured one is held to the shuffle.
    """
    extra = [name for name in table.columns if name not in keys]
    if size is None and share > 0:
        size = table_bytes(table)
    wanted = [*[F.col(f"l.{name}") for name in facts.columns], *[F.col(f"r.{name}") for name in extra]]
    if size is not None and size <= BROADCAST_BYTES:
        return facts.alias("l").join(F.broadcast(table).alias("r"), on_keys(keys), "left").select(*wanted)
    if size is not None:
        table = table.hint("merge")
    n = salts(facts, share)
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    spread = F.xxhash64(*([salt_by] if salt_by else facts.columns))
    if n == 1:  # by the keys alone: tables stored in buckets by them are not moved
        joined = facts.where(~missing).alias("l").join(table.alias("r"), on_keys(keys), "left").select(*wanted)
    else:
        salted_facts = facts.where(~missing).withColumn("_salt", F.pmod(spread, F.lit(n)))
        salted_table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
        joined = salted_facts.alias("l").join(salted_table.alias("r"), on_keys([*keys, "_salt"]), "left").select(*wanted)
    types = dict(table.dtypes)
    return joined.unionByName(facts.where(missing).select(
        *facts.columns, *[F.lit(None).cast(types[name]).alias(name) for name in extra]))


def duplicate_keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; must be empty before a table is looked up."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def join_events(packages: DataFrame, per_order: DataFrame) -> DataFrame:
    """Packages with the event aggregates of their order; ids compared as text.

    An order has few packages, so its key is not salted; packages without an order id match
    nothing and stay where they are.
    """
    left = packages.withColumn("order_id", F.col("order_id").cast("string"))
    right = per_order.withColumn("order_id", F.col("order_id").cast("string")).where(F.col("order_id").isNotNull())
    return lookup(left, right, ["order_id"], share=0.0)


def join_itineraries(packages: DataFrame, features: DataFrame, mapping: DataFrame) -> DataFrame:
    """Packages with the itinerary features of their order, through the id mapping.

    ``mapping`` has ``order_id`` (itinerary id) and ``order_compra`` (package order id). A package
    must not be multiplied: of several itineraries of one order the one with the smallest id
    counts, and of several feature rows of one itinerary the first by all their columns.
    """
    pairs = (mapping.select(F.col("order_id").alias("_itinerary"), F.col("order_compra").cast("string").alias("_order"))
             .where(F.col("_itinerary").isNotNull() & F.col("_order").isNotNull()))
    names = [c for c in features.columns if c != "order_id"]
    mapped = (features.where(F.col("order_id").isNotNull())
              .join(pairs, F.col("order_id") == F.col("_itinerary"))
              .groupBy(F.col("_order").alias("order_id")).agg(F.min(F.struct("_itinerary", *names)).alias("_f"))
              .select("order_id", *[F.col(f"_f.{c}").alias(c) for c in names]))
    left = packages.withColumn("order_id", F.col("order_id").cast("string"))
    return lookup(left, mapped, ["order_id"], share=0.0)


def known_to(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows with a match (semi join)."""
    return left.alias("l").join(right.alias("r"), on_keys(keys), "left_semi")


def unknown_to(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows without a match (anti join)."""
    return left.alias("l").join(right.alias("r"), on_keys(keys), "left_anti")
