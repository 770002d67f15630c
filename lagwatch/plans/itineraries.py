"""From raw itinerary documents to the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import itinerary as I


def parse_itineraries(raw: DataFrame, strict: bool = False) -> DataFrame:
    """One row per order with every parsed feature.

    Each feature is parsed on its own by default. ``strict`` reproduces a parse
    that stops at the first broken operation: without a ``type`` everything about
    operations is NULL, with an explicit-null operator all that follows it is.
    """
    parsed = raw.select(
        "order_id",
        I.parse_promised(F.col("promised_raw")).alias("promised"),
        I.parse_operations(F.col("ops_raw")).alias("ops"),
        *([I.parse_operation_keys(F.col("ops_raw")).alias("op_keys")] if strict else []),
    )
    ops = F.col("ops")
    features = {**I.operation_features(ops), **I.time_features(ops)}
    if strict:
        broken = F.coalesce(I.lacks_type(F.col("op_keys")), F.lit(True))
        stopped = F.coalesce(I.null_operator(F.col("op_keys")), F.lit(True))
        features = {
            name: F.when(~(broken | stopped) if name in I.AFTER_OPERATORS else ~broken, value)
            for name, value in features.items()
        }
    return parsed.select(
        "order_id",
        *[value.alias(name) for name, value in I.promised_features(F.col("promised")).items()],
        *[value.alias(name) for name, value in features.items()],
    )


def add_route_risk(parsed: DataFrame) -> DataFrame:
    """Complexity score, span ratio and the four route flags."""
    return (parsed
            .withColumns({"complexity_score": I.complexity_score(), "span_ratio": I.span_ratio()})
            .withColumns(I.risk_flags()))


def itinerary_features(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Parsed features plus route risk."""
    return add_route_risk(parse_itineraries(raw, strict))


def export_features(features: DataFrame) -> DataFrame:
    """The 24 exported columns, in their fixed order."""
    return features.select(*C.ITINERARY_EXPORT_COLUMNS)
