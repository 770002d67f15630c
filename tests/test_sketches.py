"""Merged day summaries against the exact rows."""

import pytest
from pyspark.sql import functions as F

from lagwatch.operators import sketches as sk
from lagwatch.operators.classification import area_metrics, score_curve


@pytest.fixture(scope="module")
def rows(spark):
    x = F.xxhash64("id")
    return spark.range(40_000).select(
        F.date_add(F.lit("2024-01-01"), (F.col("id") % 30).cast("int")).alias("day"), (F.col("id") % 3).alias("g"),
        F.when(F.col("id") % 50 != 0, F.pmod(x, F.lit(100_000)) / F.when(F.col("id") % 3 == 0, 100.0).otherwise(9000.0)).alias("v"),
        F.when(F.col("id") % 3 == 2, F.lit(1.0)).otherwise(F.pmod(x, F.lit(9760)) / 9770.0).alias("score"),
        F.when(F.col("id") % 11 != 0, (F.pmod(F.xxhash64(x), F.lit(1000)) < F.pmod(x, F.lit(9760)) / 30).cast("int")).alias("label"),
        F.concat(F.lit("k"), F.pmod(x, F.lit(7000))).alias("key")).cache()


@pytest.mark.parametrize("days", ["2024-01-30", "2024-01-03"])
def test_quantiles_of_a_look_back(rows, days):
    part = rows.where(F.col("day") <= days)
    stored = sk.day_quantiles(rows, F.col("day"), "v", ["g"]).where(F.col("day") <= days)
    found = sk.merged_quantiles(stored, [0.0, 0.1, 0.5, 0.9, 1.0], ["g"])
    errors = sk.rank_errors(found, part, "v", ["g"]).collect()
    assert len(errors) == 15 and max(r["rank_error"] for r in errors) < 2 * sk.rank_error()
    n = {r["g"]: r["n"] for r in part.groupBy("g").agg(F.count("v").alias("n")).collect()}
    assert {r["g"]: r["n"] for r in found.collect()} == n == {r["g"]: r["n"] for r in errors}


def test_no_values_no_quantiles(rows):
    none = rows.where("g = 5")
    assert sk.merged_quantiles(sk.day_quantiles(none, F.col("day"), "v", ["g"]), [0.5], ["g"]).collect() == []
    empty = sk.day_quantiles(rows.withColumn("v", F.lit(None).cast("double")), F.col("day"), "v", ["g"])
    assert sk.merged_quantiles(empty, [0.5], ["g"]).collect() == []


def test_distinct_values_of_a_look_back(rows):
    stored = sk.day_distincts(rows, F.col("day"), ["key", "g"], []).where("day <= '2024-01-20'")
    found = sk.merged_distincts(stored, ["key", "g"]).first()
    exact = rows.where("day <= '2024-01-20'").agg(F.count_distinct("key").alias("key"), F.count_distinct("g").alias("g")).first()
    assert found["g"] == exact["g"] and abs(found["key"] / exact["key"] - 1) < 4 * sk.distinct_error()


@pytest.mark.parametrize("bins", [1, 10, 1000])
def test_exact_areas_lie_between_the_bounds(rows, bins):
    part = rows.where("day > '2024-01-10'")
    stored = sk.day_score_bins(rows, F.col("day"), "score", "label", bins).where("day > '2024-01-10'")
    for groups in ([], ["month"]):
        found = sk.binned_areas(stored.withColumn("month", F.lit(1)), groups).first()
        exact = area_metrics(score_curve(part, "score", "label")).first()
        assert found["n"] == exact["n"] and found["positives"] == exact["positives"]
        assert found["pr_auc_low"] <= exact["pr_auc"] + 1e-12 and exact["pr_auc"] <= found["pr_auc_high"] + 1e-12
        assert found["roc_auc_low"] <= exact["roc_auc"] + 1e-12 and exact["roc_auc"] <= found["roc_auc_high"] + 1e-12
    if bins == 1000:
        assert found["pr_auc_high"] - found["pr_auc_low"] < 0.12


def test_areas_without_positives_or_rows(rows):
    stored = sk.day_score_bins(rows.withColumn("label", F.lit(0)), F.col("day"), "score", "label")
    assert sk.binned_areas(stored).first()["pr_auc_low"] is None
    assert sk.binned_areas(stored.limit(0), ["day"]).collect() == []
