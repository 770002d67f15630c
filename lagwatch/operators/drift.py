"""Monitoring: performance loss, distribution drift, unseen categories, decision."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .classification import area_metrics, score_curve, threshold_metrics
from .order_stats import exact_quantiles, long_form, running_totals


def recent_rows(log: DataFrame, as_of: Column, days: int = C.WINDOW_DAYS) -> DataFrame:
    """Log rows of the last ``days`` before ``as_of``."""
    return log.where(F.col("timestamp") >= as_of - F.make_dt_interval(F.lit(days)))


def label_coverage(recent: DataFrame) -> DataFrame:
    n, known = F.count("*"), F.count("actual_outcome")
    return recent.agg(n.alias("n"), known.alias("labelled"),
                      (known * 100.0 / F.greatest(n, F.lit(1))).alias("labelled_pct"))


def daily_trend(log: DataFrame, days: int = C.WINDOW_DAYS) -> DataFrame:
    """Sliding look-back metrics, one row per window of ``days`` starting each day.

    Rows are reduced to days first; only the small day table is repeated for the
    windows a day belongs to.
    """
    flagged = F.col("risk_score") >= C.ACTIVE_THRESHOLD
    late = F.col("actual_outcome") == 1
    per_day = log.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("n"), F.count("actual_outcome").alias("labelled"),
        F.count_if(late).alias("late"), F.count_if(late & flagged).alias("caught"))
    windows = per_day.withColumn("window_start", F.explode(F.sequence(
        F.date_sub("day", days - 1), F.col("day"))))
    return windows.groupBy("window_start").agg(
        *[F.sum(m).cast("bigint").alias(m) for m in ("n", "labelled", "late", "caught")])


def performance_check(recent: DataFrame, baseline_pr_auc: float = C.MIN_PR_AUC) -> DataFrame:
    """Average precision and recall of the labelled recent rows against the baseline.

    One row. With fewer than 100 labels nothing is triggered.
    """
    labelled = recent.where(F.col("actual_outcome").isNotNull() & F.col("risk_score").isNotNull())
    areas = area_metrics(score_curve(labelled, "risk_score", "actual_outcome"))
    at = threshold_metrics(labelled, "risk_score", "actual_outcome", {"default": C.ACTIVE_THRESHOLD})
    recall = F.coalesce(at.select("recall").scalar(), F.lit(0.0))
    base = F.lit(float(baseline_pr_auc))
    drop = (base - F.coalesce(F.col("pr_auc"), F.lit(0.0))) / F.greatest(base, F.lit(1e-8))
    measured = areas.select(
        F.coalesce("n", F.lit(0)).alias("n_labelled"), "pr_auc", base.alias("baseline_pr_auc"),
        drop.alias("pr_auc_drop"), recall.alias("recall"))
    enough = F.col("n_labelled") >= C.MIN_LABELLED
    return measured.withColumns({
        "pr_auc_trigger": enough & (F.col("pr_auc_drop") > C.PR_AUC_DROP),
        "recall_trigger": enough & (F.col("recall") < C.TRIGGER_RECALL),
    }).withColumn("trigger", F.col("pr_auc_trigger") | F.col("recall_trigger"))


def reference_stats(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, range and 20 percentiles of each raw feature."""
    values = long_form(train, features).where(F.col("value").isNotNull() & ~F.isnan("value"))
    moments = values.groupBy("feature").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    last = C.REFERENCE_PERCENTILES - 1
    probs = [i / last for i in range(last + 1)]
    quantiles = exact_quantiles(values, F.col("value"), probs, ["feature"])
    # twenty rows per feature: a bounded list
    lists = quantiles.groupBy("feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("prob", "quantile"))),
                    lambda q: q["quantile"]).alias("percentiles"))
    return moments.alias("m").join(lists.alias("l"), F.col("m.feature") == F.col("l.feature")).select(
        "m.*", "percentiles")


def reference_sample(stats: DataFrame) -> DataFrame:
    """The percentile list of each feature, read off at 1000 even points."""
    knots, last = F.col("percentiles"), C.REFERENCE_PERCENTILES - 1
    place = F.col("i") * float(last) / float(C.REFERENCE_POINTS - 1)
    j = F.least(F.floor(place), F.lit(last - 1)).cast("int")
    low, high = F.get(knots, j), F.get(knots, j + 1)
    points = stats.select("feature", "percentiles", F.explode(
        F.sequence(F.lit(0), F.lit(C.REFERENCE_POINTS - 1))).alias("i"))
    return points.select("feature", (low + (high - low) * (place - j)).alias("value"))


def ks_statistics(recent: DataFrame, sample: DataFrame, features: Sequence[str]) -> DataFrame:
    """Two-sample KS distance per feature with at least 30 recent values.

    Both samples are counted per distinct value and merged in one ordered running
    total, so the distance is exact and no feature is gathered in one place.
    """
    values = (long_form(recent, features).where(F.col("value").isNotNull() & ~F.isnan("value"))
              .select("feature", "value", F.lit(1).alias("new"), F.lit(0).alias("ref")))
    known = sample.select("feature", "value", F.lit(0).alias("new"), F.lit(1).alias("ref"))
    counts = values.unionByName(known).groupBy("feature", "value").agg(
        F.sum("new").alias("new"), F.sum("ref").alias("ref"))
    ranked = running_totals(counts, [F.col("value")], ["new", "ref"], ["feature"])
    gap = F.abs((F.col("new_before") + F.col("new")) / F.col("new_total")
                - (F.col("ref_before") + F.col("ref")) / F.col("ref_total"))
    usable = ranked.where((F.col("new_total") >= C.MIN_KS_VALUES) & (F.col("ref_total") > 0))
    return usable.groupBy("feature").agg(
        F.max(gap).alias("ks_stat"), F.first("new_total").cast("bigint").alias("n_recent"),
        F.first("ref_total").cast("bigint").alias("n_reference"))


def ks_p_value(distance: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value with the usual small-sample correction."""
    root = F.sqrt(n * m / (n + m))
    scaled = (root + 0.12 + F.lit(0.11) / root) * distance
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * scaled * scaled))
    # the series does not converge near zero, where the p-value is 1
    return F.when(scaled < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(2.0 * terms, F.lit(0.0)), F.lit(1.0)))


def exact_ks_p_value(distance: float, n: int, m: int) -> float:
    """Probability that two samples of one continuous distribution are at least this far apart.

    All orders of n and m values are equally likely; a path of n + m steps takes one value of either
    sample at a time. The probability of having stayed nearer than the distance is carried from
    one number of steps to the next, for all numbers of values of the first sample at once.
    """
    n, m = min(n, m), max(n, m)
    unit = math.gcd(n, m)
    a, b = m // unit, n // unit
    limit = round(distance * a * n)  # the distance in steps of 1 / lcm(n, m)
    if limit <= 0:
        return 1.0
    i = np.arange(n + 1)
    inside = np.zeros(n + 1)
    inside[0] = 1.0
    for k in range(1, n + m + 1):
        j = k - i
        left = n + m - k + 1
        from_first = np.concatenate([[0.0], inside[:-1] * (n - i[:-1])]) / left
        from_second = inside * np.maximum(m - j + 1, 0) / left
        inside = np.where((j >= 0) & (j <= m) & (np.abs(i * a - j * b) < limit), from_first + from_second, 0.0)
    return float(min(1.0, max(0.0, 1.0 - inside[n])))


def with_p_values(ks: DataFrame, exact_upto: int = C.EXACT_KS_VALUES) -> DataFrame:
    """Add ``p_value`` to the few rows of distances, one per feature: exact where neither sample has more
    than ``exact_upto`` values, asymptotic beyond it, as the test the thresholds were set for. The exact one
    takes n * (n + m) steps."""
    asymptotic = ks.withColumn("p_value", ks_p_value(F.col("ks_stat"), F.col("n_recent"), F.col("n_reference")))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            small = part[["n_recent", "n_reference"]].max(axis=1) <= exact_upto
            part.loc[small, "p_value"] = [exact_ks_p_value(d, int(n), int(m)) for d, n, m in
                                          zip(part.ks_stat[small], part.n_recent[small], part.n_reference[small], strict=True)]
            yield part

    return asymptotic.mapInPandas(exact, asymptotic.schema)


def feature_drift(recent: DataFrame, stats: DataFrame, features: Sequence[str], exact_upto: int = C.EXACT_KS_VALUES) -> DataFrame:
    """Distance, p-value and drift flag per feature."""
    ks = with_p_values(ks_statistics(recent, reference_sample(stats), features), exact_upto)
    return ks.withColumns({
        "drift": F.col("p_value") < C.KS_P_VALUE,
        "critical": F.col("feature").isin(C.CRITICAL_DRIFT_FEATURES)})


def known_categories(train: DataFrame, columns: Sequence[str] = tuple(C.WATCHED_CATEGORIES)) -> DataFrame:
    """Distinct values per watched column."""
    return (long_form(train, columns, name="column", kind="string")
            .where(F.col("value").isNotNull()).distinct())


def new_categories(recent: DataFrame, known: DataFrame,
                   columns: Sequence[str] = tuple(C.WATCHED_CATEGORIES)) -> DataFrame:
    """Recent values the known table lacks. Columns without any known value are skipped."""
    current = known_categories(recent, columns)
    watched = known.select("column").distinct()
    unseen = current.alias("l").join(
        known.alias("r"), (F.col("l.column") == F.col("r.column")) & (F.col("l.value") == F.col("r.value")),
        "left_anti")
    return unseen.alias("u").join(
        F.broadcast(watched).alias("w"), F.col("u.column") == F.col("w.column"), "left_semi")


def retrain_decision(performance: DataFrame, drift: DataFrame, unseen: DataFrame) -> DataFrame:
    """One row: a flag per check, the decision, and the reasons that apply.

    The number of unseen values is reported, not the list, which may be long.
    """
    critical = drift.agg(
        F.count_if("drift").alias("drifted"),
        F.count_if(F.col("drift") & F.col("critical")).alias("critical"))
    names = drift.where("drift").agg(F.array_join(F.array_sort(F.collect_list("feature")), ", ")).scalar()
    per_column = unseen.groupBy("column").agg(F.count("*").alias("n"))
    listed = per_column.agg(F.array_join(F.array_sort(F.collect_list(
        F.concat_ws(": ", "column", F.col("n").cast("string")))), ", ")).scalar()
    base = performance.select(
        "n_labelled", "pr_auc_trigger", "recall_trigger", "pr_auc_drop", "recall",
        (critical.select("critical").scalar() >= 2).alias("drift_trigger"),
        critical.select("drifted").scalar().alias("drifted_features"),
        F.coalesce(per_column.agg(F.sum("n")).scalar(), F.lit(0)).alias("new_values"),
        names.alias("_names"), listed.alias("_listed"))
    flags = base.withColumns({
        "performance_trigger": F.col("pr_auc_trigger") | F.col("recall_trigger"),
        "category_trigger": F.col("new_values") > 0,
    })
    reasons = F.array_compact(F.array(
        F.when(F.col("pr_auc_trigger"), F.format_string(C.REASON_PR_AUC.format(limit=C.PR_AUC_DROP * 100), F.col("pr_auc_drop") * 100)),
        F.when(F.col("recall_trigger"), F.format_string(C.REASON_RECALL.format(limit=C.TRIGGER_RECALL), "recall")),
        F.when(F.col("drift_trigger"), F.format_string(C.REASON_DRIFT, "_names")),
        F.when(F.col("category_trigger"), F.format_string(C.REASON_CATEGORIES.format(), "_listed"))))
    decided = flags.withColumn("should_retrain", F.col("performance_trigger")
                               | F.col("drift_trigger") | F.col("category_trigger"))
    return decided.select(
        "n_labelled", "performance_trigger", "drift_trigger", "category_trigger",
        F.col("drifted_features").cast("bigint").alias("drifted_features"),
        F.col("new_values").cast("bigint").alias("new_values"), "should_retrain",
        reasons.alias("reasons"))
