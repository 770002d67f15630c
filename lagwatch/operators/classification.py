"""Exact classification metrics from score groups.

All inputs are frames with a score and a 0/1 label. Rows of equal score form one
group, so ties are handled as a threshold sees them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.numeric import ratio, ratio_or_zero
from .order_stats import running_totals


def score_curve(df: DataFrame, score: str, label: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score: rows ``k`` and positives ``tp`` at or above it, the
    totals ``n`` and ``pos``, and its own ``c`` rows and ``p`` positives."""
    groups = list(group_cols)
    counts = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
              .groupBy(*groups, F.col(score).cast("double").alias("score"))
              .agg(F.count("*").alias("c"), F.sum(F.col(label).cast("bigint")).alias("p")))
    ranked = running_totals(counts, [F.col("score").desc()], ["c", "p"], groups)
    return ranked.select(
        *groups, "score", "c", "p",
        (F.col("c_before") + F.col("c")).alias("k"), (F.col("p_before") + F.col("p")).alias("tp"),
        F.col("c_total").alias("n"), F.col("p_total").alias("pos"))


def _curve_rates() -> dict[str, Column]:
    fp = F.col("k") - F.col("tp")
    return {
        "precision": F.col("tp") / F.col("k"),
        "recall": ratio_or_zero(F.col("tp"), F.col("pos")),
        "fpr": ratio_or_zero(fp, F.col("n") - F.col("pos")),
    }


def curve_points(curve: DataFrame) -> DataFrame:
    """Precision, recall and false-alarm rate at every distinct score."""
    rates = _curve_rates()
    return curve.select("score", *[rates[name].alias(name) for name in ("precision", "recall", "fpr")])


def area_metrics(curve: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Average precision (step sum) and ROC area with ties.

    Both are NULL without positives; the ROC area also without negatives.
    """
    negatives = F.col("n") - F.col("pos")
    step = F.col("p") / F.col("pos") * F.col("tp") / F.col("k")
    # pairs won by this group's negatives: positives above plus half of the tied ones
    area = (F.col("c") - F.col("p")) * (F.col("tp") - F.col("p") / F.lit(2.0))
    return curve.groupBy(*group_cols).agg(
        F.sum(F.when(F.col("pos") > 0, step)).alias("pr_auc"),
        ratio(F.sum(area), F.max("pos").cast("double") * F.max(negatives)).alias("roc_auc"),
        F.max("n").alias("n"), F.max("pos").alias("positives"))


def threshold_metrics(df: DataFrame, score: str, label: str,
                      thresholds: dict[str, float] = C.THRESHOLDS,
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates at each threshold, from one pass over the rows."""
    groups = list(group_cols)
    positive = F.col(label) == 1
    labelled = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = []
    for name, at in thresholds.items():
        flagged = F.col(score) >= at
        counts += [
            F.count_if(flagged & positive).alias(f"{name}_tp"),
            F.count_if(flagged & ~positive).alias(f"{name}_fp"),
            F.count_if(~flagged & ~positive).alias(f"{name}_tn"),
            F.count_if(~flagged & positive).alias(f"{name}_fn"),
        ]
    rows = ", ".join(
        f"'{name}', CAST({at} AS DOUBLE), `{name}_tp`, `{name}_fp`, `{name}_tn`, `{name}_fn`"
        for name, at in thresholds.items())
    wide = labelled.groupBy(*groups).agg(*counts)
    long = wide.select(*groups, F.expr(
        f"stack({len(thresholds)}, {rows}) AS (name, threshold, tp, fp, tn, fn)"))
    return with_rates(long)


def with_rates(confusion: DataFrame) -> DataFrame:
    """Rates of confusion counts; a zero denominator gives 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return confusion.withColumns({
        "precision": ratio_or_zero(tp, tp + fp),
        "recall": ratio_or_zero(tp, tp + fn),
        "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
        "tasa_deteccion": ratio_or_zero(tp, tp + fn),
        "tasa_falsa_alarma": ratio_or_zero(fp, fp + tn),
    })


def accepted(metrics: DataFrame) -> DataFrame:
    """Add whether a threshold meets the recall and precision minima."""
    return metrics.withColumn(
        "accepted", (F.col("recall") >= C.MIN_RECALL) & (F.col("precision") >= C.MIN_PRECISION))


def calibrate(curve: DataFrame) -> DataFrame:
    """Threshold of the best F1, and of the best recall at acceptable precision.

    Equal values go to the lowest threshold. Only scores are thresholds. Without an
    acceptable precision the active threshold stands in and its values are NULL.
    """
    rates = _curve_rates()
    f1 = 2 * rates["precision"] * rates["recall"] / F.greatest(
        rates["precision"] + rates["recall"], F.lit(1e-8))
    points = curve.select("score", rates["precision"].alias("precision"),
                          rates["recall"].alias("recall"), f1.alias("f1"))
    good = F.col("precision") >= C.MIN_PRECISION
    best = points.agg(
        F.max(F.struct("f1", (-F.col("score")).alias("low"))).alias("f"),
        F.max(F.when(good, F.struct("recall", (-F.col("score")).alias("low"), "precision"))).alias("r"))
    return best.select(
        (-F.col("f.low")).alias("threshold_f1"), F.col("f.f1").alias("f1_at_threshold_f1"),
        F.coalesce(-F.col("r.low"), F.lit(C.ACTIVE_THRESHOLD)).alias("threshold_recall"),
        F.col("r.recall").alias("recall_at_threshold_recall"),
        F.col("r.precision").alias("precision_at_threshold_recall"))


def targets_met(metrics: DataFrame) -> DataFrame:
    """Quality targets over columns ``pr_auc``, ``precision`` and ``recall``."""
    return metrics.withColumns({
        "pr_auc_ok": F.coalesce(F.col("pr_auc") >= C.MIN_PR_AUC, F.lit(False)),
        "precision_ok": F.col("precision") >= C.MIN_PRECISION,
        "recall_ok": F.col("recall") >= C.MIN_RECALL,
    }).withColumn("targets_met", F.col("pr_auc_ok") & F.col("precision_ok") & F.col("recall_ok"))


def fold_average(folds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of each metric over the folds."""
    return folds.agg(*[F.avg(m).alias(m) for m in metrics],
                     *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics])
