"""Derived tables written once per session, as a pipeline stores its steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lagwatch.session import scratch_path, store

#: Columns of names that hardly repeat: a dictionary of them is given up again, after the work of making it.
_NAMES = {f"parquet.enable.dictionary#{c}": "false" for c in ("package_id", "order_id", "producto", "origen")}

_PATHS: dict[tuple[str, str, str], str] = {}


def staged(spark: SparkSession, d: str, name: str,
           build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The named table derived from folder ``d``: written to the shared folder on first
    use, then read back with column pruning and filters at the scan."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _PATHS:
        path = scratch_path(spark, name)
        store(build(spark, d), path, **_NAMES)
        _PATHS[key] = path
    return spark.read.parquet(_PATHS[key])


def staged_before(spark: SparkSession, d: str, name: str) -> bool:
    return (spark.sparkContext.applicationId, d, name) in _PATHS
