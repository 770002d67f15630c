"""Stored summaries per day that can be merged: quantiles, distinct counts, score bins.

The exact operators read every row of a look-back again. These read the rows of a day once; any
look-back after that is a merge of a few small rows, within a stated error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..session import written
from .joins import BROADCAST_ROWS

#: Size parameter of quantile sketches, and log2 of the registers of distinct-count sketches.
QUANTILE_K, DISTINCT_LG_K = 400, 14
#: Bins of a score between 0 and 1.
SCORE_BINS = 1000


def rank_error(k: int = QUANTILE_K) -> float:
    """Distance of a sketched quantile's rank from the rank asked for, as a share of all rows, that
    99 of 100 sketches keep (the published fit for this kind of sketch)."""
    return 2.296 / k ** 0.9021


def distinct_error(lg_k: int = DISTINCT_LG_K) -> float:
    """Relative standard error of a merged distinct count."""
    return 1.04 / math.sqrt(1 << lg_k)


def day_quantiles(rows: DataFrame, day: Column, value: str, groups: Sequence[str] = (), k: int = QUANTILE_K) -> DataFrame:
    """``groups, day, sketch``: the values of a day; missing ones are left out."""
    x = F.col(value).cast("double")
    return (rows.where(x.isNotNull() & ~F.isnan(x)).groupBy(*groups, day.alias("day"))
            .agg(F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch")))


def merged_quantiles(sketches: DataFrame, probs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """``groups, prob, quantile, n`` over all days of the table: filter it for a look-back."""
    merged = sketches.groupBy(*groups).agg(F.kll_merge_agg_double("sketch").alias("_s")).where(F.col("_s").isNotNull())
    asked = F.array(*[F.lit(float(p)) for p in probs])
    found = merged.select(*groups, F.kll_sketch_get_n_double("_s").alias("n"), F.explode(
        F.arrays_zip(asked.alias("prob"), F.kll_sketch_get_quantile_double("_s", asked).alias("quantile"))).alias("_q"))
    return found.select(*groups, "_q.prob", "_q.quantile", "n")


def rank_errors(quantiles: DataFrame, rows: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """How far each quantile's rank among the rows themselves is from its ``prob``: one pass over the
    rows, with one row of quantiles per group beside it. A value that many rows share holds a range of ranks.

    A group may hold any share of the rows: the quantiles of few groups go to the rows, and only counts are
    shuffled, so no task holds a group."""
    asked = quantiles.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("prob", "quantile"))).alias("_q"))
    asked = written(asked, "asked")  # read for its size, by the rows and by the counts
    size = asked.agg(F.count("*").alias("groups"), F.max(F.size("_q")).alias("probs")).first()
    probs = size["probs"] or 1
    x = F.col(value).cast("double")
    beside = F.broadcast(asked) if size["groups"] * probs <= BROADCAST_ROWS else asked
    # counts alone are a plain row per group; the list of quantiles comes back to them afterwards
    joined = rows.where(x.isNotNull() & ~F.isnan(x)).join(beside, list(groups))
    counts = joined.groupBy(*groups).agg(F.count("*").alias("n"), *[
        F.count_if(test).alias(f"_{name}{i}") for i in range(probs) for name, test in (
            ("below", x < F.col("_q")[i]["quantile"]), ("upto", x <= F.col("_q")[i]["quantile"]))])
    counts = counts.join(beside, list(groups)).withColumn("_c", F.array(*[
        F.struct(F.col(f"_below{i}").alias("below"), F.col(f"_upto{i}").alias("upto")) for i in range(probs)]))
    each = counts.select(*groups, "n", F.explode(F.arrays_zip("_q", "_c")).alias("_e")).select(
        *groups, "n", "_e._q.prob", (F.col("_e._c.below") / F.col("n")).alias("low"), (F.col("_e._c.upto") / F.col("n")).alias("high"))
    return each.select(*groups, "prob", "n", F.greatest(F.lit(0.0), F.col("low") - F.col("prob"), F.col("prob") - F.col("high")).alias("rank_error"))


def day_distincts(rows: DataFrame, day: Column, columns: Sequence[str], groups: Sequence[str] = (), lg_k: int = DISTINCT_LG_K) -> DataFrame:
    """``groups, day`` and a sketch of the distinct values of each column."""
    return rows.groupBy(*groups, day.alias("day")).agg(*[
        F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias(c) for c in columns])


def merged_distincts(sketches: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Distinct values of each column over all days of the table, an estimate."""
    return sketches.groupBy(*groups).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])


def day_score_bins(rows: DataFrame, day: Column, score: str, label: str, bins: int = SCORE_BINS) -> DataFrame:
    """``day, bin, c, p, least, most``: rows and positives per bin of the score, and the scores it spans;
    unlabelled rows are left out."""
    x = F.col(score).cast("double")
    place = F.least(F.greatest(F.floor(x * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return (rows.where(x.isNotNull() & ~F.isnan(x) & F.col(label).isNotNull()).groupBy(day.alias("day"), place.alias("bin"))
            .agg(F.count("*").alias("c"), F.sum(F.col(label).cast("bigint")).alias("p"), F.min(x).alias("least"), F.max(x).alias("most")))


def binned_areas(day_bins: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Bounds of the two areas over all days of the table: the exact areas, ties included, lie between.

    Rows of different bins are ordered as their scores are. A bin with a single score is a tie, and exact. Of
    the pairs within another bin none or all may be won. In such a bin of ``c`` rows and ``p`` positives behind ``k`` rows and ``t`` positives, the precision at
    a positive is at least ``(t+1)/(k+c-p+1)`` and at most ``(t+p)/(k+p)``.
    """
    bins = day_bins.groupBy(*groups, "bin").agg(F.sum("c").alias("c"), F.sum("p").alias("p"), (F.min("least") == F.max("most")).alias("tie"))
    # a group has no more bins than were asked for, so it is one short list
    listed = bins.groupBy(*groups).agg(F.sum("c").alias("n"), F.sum("p").alias("positives"),
                                       F.sort_array(F.collect_list(F.struct("bin", "c", "p", "tie")), asc=False).alias("_b"))
    kinds = "struct<k:bigint,t:bigint,low:double,high:double,won:double,tied:double,open:double>"
    start = F.struct(F.lit(0), F.lit(0), *[F.lit(0.0)] * 5).cast(kinds)

    def add(a: Column, b: Column) -> Column:
        c, p, k, t, tie = b["c"], b["p"], a["k"], a["t"], b["tie"]
        low = F.when(tie, (t + p) / (k + c)).otherwise((t + 1) / (k + c - p + 1))
        high = F.when(tie, (t + p) / (k + c)).otherwise((t + p) / (k + p))
        within = ((c - p) * p).cast("double")
        return F.struct(
            k + c, t + p, a["low"] + F.when(p > 0, p * low).otherwise(0.0), a["high"] + F.when(p > 0, p * high).otherwise(0.0),
            a["won"] + ((c - p) * t).cast("double"), a["tied"] + F.when(tie, within).otherwise(0.0),
            a["open"] + F.when(tie, 0.0).otherwise(within)).cast(kinds)

    total = listed.withColumn("_a", F.aggregate("_b", start, add))
    positives, pairs = F.col("positives").cast("double"), F.col("positives").cast("double") * (F.col("n") - F.col("positives"))
    return total.select(
        *groups, "n", "positives", ratio(F.col("_a.low"), positives).alias("pr_auc_low"), ratio(F.col("_a.high"), positives).alias("pr_auc_high"),
        ratio(F.col("_a.won") + F.col("_a.tied") / 2, pairs).alias("roc_auc_low"),
        ratio(F.col("_a.won") + F.col("_a.tied") / 2 + F.col("_a.open"), pairs).alias("roc_auc_high"))
