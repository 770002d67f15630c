"""Aggregates over the package table and the labelled dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.numeric import share
from ..operators.frequency import late_rate, month_of
from ..operators.histograms import equal_width_histogram
from ..operators.order_stats import exact_medians, long_form

COMPARED = ["num_ops", "num_processes", "num_legs", "num_transfers", "total_span_hours",
            "picking_window_hours", "complexity_score", "span_ratio"]


def delivery_overview(packages: DataFrame) -> DataFrame:
    """Packages, distinct orders, delivered and pending shares, and the outcome shares
    of the delivered ones; one row."""
    state = F.col("estado_entrega")
    delivered = F.count_if(state.isin(C.LATE_STATES + C.ON_TIME_STATES))
    n = F.count("*")
    return packages.agg(
        n.alias("packages"), F.count_distinct("order_id").alias("orders"),
        share(delivered, n).alias("delivered_pct"), share(n - delivered, n).alias("pending_pct"),
        share(F.count_if(state == C.ON_TIME_STATES[0]), delivered).alias("early_pct"),
        share(F.count_if(state == C.ON_TIME_STATES[1]), delivered).alias("on_time_pct"),
        share(F.count_if(state == C.LATE_STATES[0]), delivered).alias("late_pct"))


def volume_and_rate(packages: DataFrame, key: str) -> DataFrame:
    """All packages per key, and the late rate of the labelled ones."""
    state = F.col("estado_entrega")
    late = F.when(state.isin(C.LATE_STATES), 1).when(state.isin(C.ON_TIME_STATES), 0)
    return packages.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("packages"), F.avg(late).alias("late_rate"))


def days_late(packages: DataFrame) -> DataFrame:
    """Late packages per number of days late."""
    return (packages.where(F.col("estado_entrega").isin(C.LATE_STATES) & F.col("dias_atraso").isNotNull())
            .groupBy("dias_atraso").agg(F.count("*").alias("n")))


def median_days_late(packages: DataFrame) -> DataFrame:
    late = packages.where(F.col("estado_entrega").isin(C.LATE_STATES))
    return exact_medians(late, F.col("dias_atraso"))


def weekly_volume(packages: DataFrame, ts: str = "fecha_creacion") -> DataFrame:
    week = F.date_format(F.date_trunc("week", F.col(ts)), "yyyy-MM-dd")
    return packages.where(F.col(ts).isNotNull()).groupBy(week.alias("week")).agg(F.count("*").alias("n"))


def monthly_rate(dataset: DataFrame) -> DataFrame:
    return late_rate(dataset, month_of("fecha_creacion"))


def monthly_carrier_rate(dataset: DataFrame, high: float = 0.3, critical: float = 0.5) -> DataFrame:
    """Monthly late rate per carrier with an alert level; the bands are parameters."""
    rates = late_rate(dataset, month_of("fecha_creacion"), "carrier")
    level = (F.when(F.col("late_rate") >= critical, "critical").when(F.col("late_rate") >= high, "high")
             .otherwise("normal"))
    return rates.withColumn("alert", level)


def worst_carriers(dataset: DataFrame, min_rows: int = 100, k: int = 10) -> DataFrame:
    return (late_rate(dataset, "carrier").where(F.col("n") >= min_rows)
            .orderBy(F.desc("late_rate"), "carrier").limit(k))


def target_shares(dataset: DataFrame) -> DataFrame:
    """Share of each target value, at three decimals."""
    counts = dataset.where(F.col(C.TARGET).isNotNull()).groupBy(C.TARGET).agg(F.count("*").alias("n"))
    return counts.select(C.TARGET, F.round(F.col("n") / counts.agg(F.sum("n")).scalar(), 3).alias("share"))


def class_histograms(dataset: DataFrame, bins: int = 30) -> DataFrame:
    """Density histograms of the compared features, per target class."""
    present = [c for c in COMPARED if c in dataset.columns]
    return equal_width_histogram(
        long_form(dataset, present, keep=[C.TARGET]), F.col("value"), bins, ["feature", C.TARGET])


def date_range(packages: DataFrame, ts: str = "fecha_creacion") -> DataFrame:
    """Range of the load and distinct values of the rate keys."""
    return packages.agg(
        F.min(ts).alias("first_date"), F.max(ts).alias("last_date"),
        F.count_distinct("carrier").alias("carriers"), F.count_distinct("region").alias("regions"))


def riskiest(scored: DataFrame, key: str, k: int = 10) -> DataFrame:
    return scored.orderBy(F.desc("risk_score"), key).limit(k)
