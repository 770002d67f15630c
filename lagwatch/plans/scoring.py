"""Score orders in batch: query rows in, predictions out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import risk
from ..functions.dates import calendar, iso_timestamp
from ..operators.contributions import row_factors
from ..operators.rates import Rates, empty_to_null
from ..schemas import FEATURE_TYPES, SCORING_QUERY, conform
from .training import RiskModel

PREDICTION = ["order_id", "risk_score", "predicted_outcome", "confidence", "disruption_type",
              "contributing_factors", "recommended_action", "timestamp", "model_version", "threshold_used"]

#: What a prediction gets after the score: its factors, and what follows from them or from the batch.
_ADDED = ("contributing_factors", "disruption_type", "timestamp", "model_version")
_FACTORS = ("array<struct<feature:string,shap_value:double,direction:string,description:string>>")


def query_features(queries: DataFrame, rates: Rates) -> DataFrame:
    """Flatten query rows to raw feature rows: context, calendar, event features, rates.

    Absent columns become NULL; a bad date leaves the calendar features NULL.
    """
    full = conform(queries, SCORING_QUERY)
    context = C.CATEGORICAL_FEATURES + C.ITINERARY_NUMERIC_FEATURES + C.ITINERARY_BOOLEAN_FEATURES
    flat = full.select(
        *[c for c in queries.columns if c not in SCORING_QUERY.fieldNames()],
        "order_id", "package_id",
        *[F.col(f"context.{name}").alias(name) for name in context],
        *[value.alias(name) for name, value in
          calendar(iso_timestamp(F.col("fecha_creacion")), weekend_if_null=None).items()],
        *C.EVENT_FEATURES)
    return conform(rates.apply(empty_to_null(flat), salt_by="order_id"), FEATURE_TYPES)


def judge(scored: DataFrame, threshold: Column) -> DataFrame:
    """Outcome, confidence and action of a ``risk_score``; rounded after comparing."""
    at = risk.effective_threshold(threshold)
    score = F.col("risk_score")
    return scored.withColumns({
        "threshold_used": at,
        "predicted_outcome": risk.outcome(score, at),
        "confidence": risk.confidence(score, at),
        "recommended_action": risk.action(score),
    }).withColumn("risk_score", F.round("risk_score", 4))


def score_queries(queries: DataFrame, model: RiskModel, as_of: Column,
                  threshold: Column | None = None, typical: dict[str, object] | None = None) -> DataFrame:
    """Predictions for a batch of query rows, one per row.

    Rows without an order id cannot be scored: they become ``error`` predictions and
    the rest of the batch goes on. With ``typical`` values each prediction carries its
    three strongest factors, made in the same pass over the rows.
    """
    threshold = F.lit(C.ACTIVE_THRESHOLD) if threshold is None else threshold
    usable = F.col("order_id").isNotNull() & (F.col("order_id") != "")
    rows = query_features(queries.where(usable), model.rates)
    scored = model.score(model.preparer.transform(rows, salt_by="package_id"))
    judged = judge(scored, threshold).select(*[c for c in PREDICTION if c not in _ADDED], "features")
    if typical:
        factors = row_factors(F.col("contributions"), model.preparer.raw_features)
        judged = model.explained(judged, typical).withColumn("contributing_factors", factors)
    else:
        judged = judged.withColumn("contributing_factors", F.array().cast(_FACTORS))
    top = F.try_element_at("contributing_factors", F.lit(1))["feature"]
    good = judged.withColumns({
        "disruption_type": risk.disruption_type(top),
        "timestamp": as_of, "model_version": F.lit(model.version)})
    # a row that cannot be scored is an error of its own, and the rest of the batch goes on
    unscored = F.col("risk_score").isNull() | F.isnan("risk_score")
    wrong = _error_columns("score missing")
    good = good.withColumns({c: F.when(unscored, wrong[c]).otherwise(F.col(c)) for c in wrong})
    bad = queries.where(~F.coalesce(usable, F.lit(False))).withColumns({
        **_error_columns("order_id missing"), "timestamp": as_of, "model_version": F.lit(model.version),
        "threshold_used": risk.effective_threshold(threshold)})
    return good.select(*PREDICTION).unionByName(bad.select(*PREDICTION))


def _error_columns(reason: str) -> dict[str, Column]:
    return {"risk_score": F.lit(0.0), "predicted_outcome": F.lit("error"), "confidence": F.lit("low"),
            "disruption_type": F.lit("processing_error"), "contributing_factors": F.array().cast(_FACTORS),
            "recommended_action": F.lit(f"ERROR: {reason}")}


def batch_summary(predictions: DataFrame) -> DataFrame:
    """Totals of a scored batch."""
    return predictions.agg(
        F.count("*").alias("total_queries"),
        F.count_if(F.col("predicted_outcome") == "fail").alias("high_risk_count"))


def prediction_log(rows: DataFrame, model: RiskModel, as_of: Column,
                   threshold: Column | None = None) -> DataFrame:
    """Log rows for later monitoring: the prediction, room for the outcome, and the raw
    features it was made from, in one pass over the feature rows."""
    judged = judge(model.predict(rows), F.lit(C.ACTIVE_THRESHOLD) if threshold is None else threshold)
    return judged.select(
        "order_id", "package_id", as_of.alias("timestamp"), "risk_score", "predicted_outcome",
        F.lit(None).cast("int").alias("actual_outcome"),
        *[c for c in rows.columns if c in FEATURE_TYPES])


def fill_outcomes(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Complete the log with outcomes known by now (``package_id``, ``outcome``, unique)."""
    known = outcomes.select("package_id", F.col("outcome").cast("int").alias("_outcome"))
    joined = log.alias("l").join(known.alias("o"), F.col("l.package_id") == F.col("o.package_id"), "left")
    return joined.select(*[
        F.coalesce("o._outcome", "l.actual_outcome").alias(c) if c == "actual_outcome" else F.col(f"l.{c}")
        for c in log.columns])
