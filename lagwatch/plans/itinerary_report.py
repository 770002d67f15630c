"""Aggregates over the itinerary features: distributions, times, risk signals, actors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import risk
from ..functions.numeric import cap, share
from ..operators.histograms import equal_width_histogram
from ..operators.order_stats import exact_medians, exact_quantiles

SIGNALS = {
    "short_picking_window": "short_picking_window",
    "anomalous_span": "anomalous_span",
    "complex_route": "complex_route",
    "seller_origin": "seller_origin",
    "three_operators": "num_operators >= 3",
}


def crossdock_share(features: DataFrame) -> DataFrame:
    """Orders with and without crossdocking; share of the orders that are known."""
    counts = features.where(F.col("has_crossdocking").isNotNull()).groupBy("has_crossdocking").agg(
        F.count("*").alias("n"))
    return counts.select("has_crossdocking", "n", share(F.col("n"), counts.agg(F.sum("n")).scalar()).alias("pct"))


def span_median(features: DataFrame) -> DataFrame:
    return exact_medians(features.where(F.col("service_category").isNotNull()),
                         F.col("total_span_hours"), ["service_category"])


def span_percentiles(features: DataFrame) -> DataFrame:
    listed = features.where(F.col("service_category").isin(C.PERCENTILE_CATEGORIES))
    return exact_quantiles(listed, F.col("total_span_hours"), [0.25, 0.5, 0.75, 0.9], ["service_category"])


def picking_summary(features: DataFrame) -> DataFrame:
    """Median picking window, and count and share (of all orders) below three hours."""
    window = F.col("picking_window_hours")
    short = F.count_if(window < 3)
    median = exact_medians(features, window).select("median").scalar()
    return features.agg(
        F.count(window).alias("n"), short.alias("short"), share(short, F.count("*")).alias("short_pct")
    ).withColumn("median", median)


def picking_histogram(features: DataFrame) -> DataFrame:
    return equal_width_histogram(features, cap(F.col("picking_window_hours"), 100), 40)


def span_ratio_histogram(features: DataFrame) -> DataFrame:
    return equal_width_histogram(features, cap(F.col("span_ratio"), 15), 50)


def signal_totals(features: DataFrame) -> DataFrame:
    """Orders per risk signal and their share, from one pass."""
    one = features.agg(F.count("*").alias("_n"),
                       *[F.count_if(F.expr(test)).alias(name) for name, test in SIGNALS.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in SIGNALS)
    return one.select("_n", F.expr(f"stack({len(SIGNALS)}, {pairs}) AS (signal, n)")).select(
        "signal", "n", share(F.col("n"), F.col("_n")).alias("pct"))


def signal_rates_by_origin(features: DataFrame) -> DataFrame:
    """Rate of three signals per origin type; a type without orders shows 0."""
    names = ["short_picking_window", "anomalous_span", "complex_route"]
    one = features.agg(*[
        F.coalesce(F.avg(F.when(F.col("origin_node_type") == kind, F.col(name).cast("int"))) * 100,
                   F.lit(0.0)).alias(f"{kind}.{name}")
        for kind in C.ORIGIN_TYPES for name in names])
    cells = ", ".join(f"'{kind}', '{name}', `{kind}.{name}`" for kind in C.ORIGIN_TYPES for name in names)
    return one.select(F.expr(f"stack({len(C.ORIGIN_TYPES) * len(names)}, {cells}) AS (origin_type, signal, pct)"))


def carrier_scores(features: DataFrame, min_orders: int = 50) -> DataFrame:
    """Mean complexity per final carrier with enough orders, its band, and the global mean."""
    stats = (features.where(F.col("final_carrier").isNotNull()).groupBy("final_carrier")
             .agg(F.avg("complexity_score").alias("mean_score"), F.count("complexity_score").alias("n"))
             .where(F.col("n") >= min_orders))
    overall = features.agg(F.avg("complexity_score")).scalar()
    return stats.select("final_carrier", "mean_score", "n", risk.carrier_band(F.col("mean_score")).alias("band"),
                        overall.alias("global_mean")).orderBy("mean_score", "final_carrier")


def start_hours(features: DataFrame) -> DataFrame:
    """Orders per start hour with the operating-peak flag."""
    return (features.where(F.col("start_hour").isNotNull()).groupBy("start_hour")
            .agg(F.count("*").alias("n"))
            .select("start_hour", "n", risk.peak_hour(F.col("start_hour")).alias("peak"))
            .orderBy("start_hour"))


def high_risk_zone(features: DataFrame) -> DataFrame:
    """Orders per category inside the zone of short windows and complex routes."""
    full = features.where(F.col("complexity_score").isNotNull() & F.col("picking_window_hours").isNotNull()
                          & F.col("service_category").isNotNull())
    window = cap(F.col("picking_window_hours"), 100)
    inside = window.between(0, 3) & F.col("complexity_score").between(60, 130)
    return full.groupBy("service_category").agg(F.count("*").alias("n"), F.count_if(inside).alias("in_zone"))


def findings(features: DataFrame, carriers: Sequence[str] = ()) -> DataFrame:
    """Headline shares and counts in one row; mean score of the carriers asked for."""
    def pct(test):
        return (F.avg(F.coalesce(test, F.lit(False)).cast("int")) * 100)

    category = F.col("service_category")
    return features.agg(
        F.count("*").alias("orders"),
        pct(category == "MESON").alias("meson_pct"),
        pct(category.isin("REGULAR", "DATE_RANGE")).alias("home_pct"),
        pct(F.col("delivery_type") == "HOME_DELIVERY").alias("home_delivery_pct"),
        pct(F.col("seller_origin")).alias("seller_pct"),
        pct(F.col("num_ops") == 2).alias("simple_pct"),
        pct(F.col("num_ops") >= 8).alias("complex_pct"),
        (F.avg(F.col("has_crossdocking").cast("int")) * 100).alias("crossdock_pct"),
        pct(F.col("short_picking_window")).alias("short_window_pct"),
        F.count_if("short_picking_window").alias("short_windows"),
        pct(F.col("anomalous_span")).alias("anomalous_pct"),
        F.count_if("anomalous_span").alias("anomalous_spans"),
        *[F.avg(F.when(F.col("final_carrier") == c, F.col("complexity_score"))).alias(f"score_{c}")
          for c in carriers])
