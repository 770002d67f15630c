"""Connected components of a link table, by alternating large and small stars.

Every round is written to the shared folder and read back, so the lineage stays short and the
rows stay on the executors; only two numbers per round reach the driver. The smallest id of each
neighbourhood is found with map-side aggregation, so a hub with any number of links is no hot
group there, and the join that brings it back may be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwatch.llm.common import staged


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20)).alias("h")).first()
    return row.n, row.h or 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each id with a link to another; the component is its smallest id."""
    edges = staged(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours point to the smallest of the neighbourhood
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = staged(large, "links")
        # small star: smaller neighbours and the id itself point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges = staged(small, "links")
        now = _mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
