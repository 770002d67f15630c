"""Exact order statistics, splits and metrics against brute force."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lagwatch.operators import classification as cls
from lagwatch.operators import drift, event_log, frequency
from lagwatch.operators import order_stats as os_
from lagwatch.operators import temporal_split as ts

LOOSE = settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def average_precision(y, s):
    order = np.argsort(-s, kind="stable")
    total, last, pos = 0.0, 0.0, y.sum()
    for cut in sorted(set(s), reverse=True):
        hit = s >= cut
        recall, precision = y[hit].sum() / pos, y[hit].mean()
        total, last = total + (recall - last) * precision, recall
    return total


def roc_area(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


def ks(a, b):
    grid = np.concatenate([a, b])
    return max(abs((a <= x).mean() - (b <= x).mean()) for x in grid)


@LOOSE
@given(st.integers(0, 10_000))
def test_areas_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    s, y = np.round(rng.random(300), 1 + seed % 2), rng.integers(0, 2, 300)
    y[:2] = [0, 1]
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": y}))
    row = cls.area_metrics(cls.score_curve(df, "s", "y")).first()
    assert row["pr_auc"] == pytest.approx(average_precision(y, s))
    assert row["roc_auc"] == pytest.approx(roc_area(y, s))


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0.2, 0), (0.4, 0)], "s double, y int")
    row = cls.area_metrics(cls.score_curve(df, "s", "y")).first()
    assert row["pr_auc"] is None and row["roc_auc"] is None
    at = {r["name"]: r for r in cls.threshold_metrics(df, "s", "y").collect()}
    assert at["low"]["precision"] == 0 and at["low"]["recall"] == 0 and at["low"]["fp"] == 1


def test_published_confusion_arithmetic(spark):
    counts = spark.createDataFrame([(138377, 35111, 33046)], "train int, val int, test int").first()
    n = sum(counts)
    assert n * 67 // 100 == counts["train"] and n * 84 // 100 == counts["train"] + counts["val"]


def test_calibration_takes_the_lowest_of_equal_thresholds(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.1, 0)], "s double, y int")
    row = cls.calibrate(cls.score_curve(df, "s", "y")).first()
    assert row["threshold_f1"] == 0.6 and row["threshold_recall"] == 0.6
    assert row["precision_at_threshold_recall"] == 0.75


@LOOSE
@given(st.integers(0, 10_000))
def test_quantiles_and_ranks_with_a_hot_group(spark, seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"g": np.where(rng.random(900) < 0.6, "hot", rng.choice(["a", "b"], 900)),
                        "x": np.where(rng.random(900) < 0.4, 1.5, np.round(rng.normal(size=900), 2))})
    df = spark.createDataFrame(pdf)
    got = os_.exact_quantiles(df, F.col("x"), [0.0, 0.25, 0.9], ["g"]).toPandas()
    for g, part in pdf.groupby("g"):
        for p in (0.0, 0.25, 0.9):
            value = got[(got.g == g) & (got.prob == p)]["quantile"].iloc[0]
            assert value == pytest.approx(part.x.quantile(p))
    keyed = df.withColumn("k", F.monotonically_increasing_id())
    ranks = os_.global_rank(keyed, [F.col("x"), F.col("k")]).toPandas().sort_values("rank")
    assert list(ranks["rank"]) == list(range(900)) and ranks["x"].is_monotonic_increasing


def test_previous_values_equal_a_lag(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.where(rng.random(500) < 0.7, "hot", "cold"), "k": rng.permutation(500), "v": rng.random(500)})
    got = os_.previous_values(spark.createDataFrame(pdf), ["k"], ["v"], ["g"]).toPandas().sort_values(["g", "k"])
    pdf = pdf.sort_values(["g", "k"])
    expected = pdf.groupby("g").v.shift().to_numpy()
    assert np.allclose(got["v_prev"].to_numpy(dtype=float), expected, equal_nan=True)


def test_split_at_exact_rows_with_one_hot_instant(spark):
    rng = np.random.default_rng(1)
    n = 1500
    pdf = pd.DataFrame({"t": pd.Timestamp("2025-01-01") + pd.to_timedelta(rng.integers(0, 40, n) * 6, unit="h"),
                        "package_id": [f"k{i:05d}" for i in rng.permutation(n)]})
    pdf.loc[: n // 2, "t"] = pd.Timestamp("2025-01-04 06:00")
    pdf.loc[n - 30:, "t"] = pd.NaT
    df = spark.createDataFrame(pdf).select(F.col("t").cast("timestamp_ntz").alias("fecha_creacion"), "package_id")
    got = {r["package_id"]: r["split"] for r in ts.temporal_split(df).collect()}
    order = pdf.sort_values(["t", "package_id"], na_position="last")["package_id"].tolist()
    expected = ["train"] * (n * 67 // 100) + ["val"] * (n * 84 // 100 - n * 67 // 100)
    expected += ["test"] * (n - len(expected))
    assert [got[k] for k in order] == expected
    cuts = ts.split_cuts(df)
    split = ts.assign_split(df, cuts)
    for name in ("train", "val", "test"):
        assert ts.only_split(split, cuts, name).count() == expected.count(name)
    blocks = ts.assign_block(df, ts.fold_cuts(df)).groupBy("block").count().collect()
    assert {r["block"]: r["count"] for r in blocks} == {b: 250 for b in (-1, 0, 1, 2, 3, 4)}


def test_empty_input_splits_to_nothing(spark):
    df = spark.createDataFrame([], "fecha_creacion timestamp_ntz, package_id string")
    assert ts.temporal_split(df).count() == 0
    cuts = ts.split_cuts(df)
    assert all(ts.only_split(ts.assign_split(df, cuts), cuts, name).count() == 0 for name in ("train", "val", "test"))


def test_cut_among_rows_without_a_date(spark):
    df = spark.range(100).select(F.lit(None).cast("timestamp_ntz").alias("fecha_creacion"),
                                 F.format_string("k%03d", "id").alias("package_id"))
    cuts = ts.split_cuts(df)
    split = ts.assign_split(df, cuts)
    assert [ts.only_split(split, cuts, name).count() for name in ("train", "val", "test")] == [67, 17, 16]


def test_ks_distance_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    train, recent = np.round(rng.normal(size=400), 1), np.round(rng.normal(0.4, 1, 300), 1)
    stats = drift.reference_stats(spark.createDataFrame(pd.DataFrame({"x": train})), ["x"])
    row = drift.feature_drift(spark.createDataFrame(pd.DataFrame({"x": recent})), stats, ["x"]).first()
    knots = np.percentile(train, np.linspace(0, 100, 20))
    sample = np.interp(np.linspace(0, 1, 1000), np.linspace(0, 1, 20), knots)
    assert row["ks_stat"] == pytest.approx(ks(sample, recent), abs=1.1 / 1000)
    assert row["drift"] and 0 <= row["p_value"] < 0.05


def test_few_values_are_not_tested_for_drift(spark):
    few = spark.createDataFrame([(float(i),) for i in range(29)], "x double")
    stats = drift.reference_stats(few, ["x"])
    assert drift.feature_drift(few, stats, ["x"]).count() == 0


@pytest.mark.parametrize(("n", "m", "d", "p"), [
    # small cases counted by hand: all orders of the values are equally likely
    (2, 2, 1.0, 1 / 3), (2, 2, 0.5, 1.0), (3, 3, 1.0, 0.1), (1, 3, 1.0, 0.5)])
def test_exact_ks_p_value(n, m, d, p):
    assert drift.exact_ks_p_value(d, n, m) == pytest.approx(p)


def test_exact_ks_p_value_against_all_orders():
    from itertools import combinations
    for n, m in ((4, 5), (3, 6), (5, 5)):
        orders = list(combinations(range(n + m), n))
        found = []
        for chosen in orders:
            i = j = 0
            far = 0.0
            for k in range(n + m):
                i, j = (i + 1, j) if k in chosen else (i, j + 1)
                far = max(far, abs(i / n - j / m))
            found.append(far)
        for d in sorted(set(round(x, 12) for x in found)):
            assert drift.exact_ks_p_value(d, n, m) == pytest.approx(sum(x >= d - 1e-9 for x in found) / len(found))


def test_ks_p_value_near_the_limit(spark):
    # published critical distances at 0.05: 1.358 * sqrt((n + m) / (n m))
    rows = [(1.358 * ((n + m) / (n * m)) ** 0.5, n, m) for n, m in ((1000, 500), (1000, 4000), (1000, 20_000))]
    got = drift.with_p_values(spark.createDataFrame(rows, "ks_stat double, n_recent long, n_reference long")).collect()
    assert all(abs(r.p_value - 0.05) < 0.004 for r in got)


def test_as_many_distinct_values_as_rows_and_null_groups(spark):
    rows = spark.range(3000).selectExpr("CAST(id * 7919 % 3001 AS DOUBLE) AS x", "CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 3 AS STRING) END AS g")
    got = {r["g"]: (r["median"], r["n"]) for r in os_.exact_medians(rows, F.col("x"), ["g"]).collect()}
    for g in (None, "1", "2"):
        mine = sorted(i * 7919 % 3001 for i in range(3000) if (None if i % 3 == 0 else str(i % 3)) == g)
        assert got[g] == ((mine[499] + mine[500]) / 2, 1000)


def test_events_without_an_order_belong_to_none(spark):
    events = spark.createDataFrame([(1, None, "packed", "2024-01-01 00:00:00"), (2, "7", "packed", "2024-01-02 00:00:00")],
                                   "event_id long, order_id string, event_type string, t string").selectExpr(
        "event_id", "order_id", "event_type", "CAST(t AS TIMESTAMP_NTZ) AS event_timestamp")
    assert [r["order_id"] for r in event_log.events_per_order(events).collect()] == ["7"]
    assert [r["order_id"] for r in event_log.event_gaps(events).collect()] == ["7"]
    assert frequency.packages_per_order(events.select("order_id")).first()["orders"] == 1


def test_both_sides_of_the_exact_p_value(spark):
    rows = [(0.3, 40, 60), (0.3, 41, 60), (0.3, 40, 61)]
    ks = spark.createDataFrame(rows, "ks_stat double, n_recent long, n_reference long")
    formula = [r.p for r in ks.select(drift.ks_p_value(F.col("ks_stat"), F.col("n_recent"), F.col("n_reference")).alias("p")).collect()]
    exact = [drift.exact_ks_p_value(*r) for r in rows]
    for upto, wanted in ((61, exact), (60, [exact[0], exact[1], formula[2]]), (59, formula)):
        assert [r.p_value for r in drift.with_p_values(ks, upto).collect()] == pytest.approx(wanted)
    assert all(abs(a - b) < 0.02 for a, b in zip(exact, formula, strict=True))

