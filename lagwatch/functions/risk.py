"""Risk bands, outcomes and factor texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def effective_threshold(threshold: Column) -> Column:
    """A missing or zero threshold means the active one."""
    return F.coalesce(F.nullif(threshold.cast("double"), F.lit(0.0)), F.lit(C.ACTIVE_THRESHOLD))


def outcome(score: Column, threshold: Column) -> Column:
    return F.when(score >= threshold, "fail").otherwise("success")


def confidence(score: Column, threshold: Column) -> Column:
    distance = F.abs(score - threshold)
    return F.when(distance >= 0.3, "high").when(distance >= 0.15, "medium").otherwise("low")


def action(score: Column) -> Column:
    """Recommended action; depends on the score alone, not on the request threshold."""
    return (F.when(score >= C.THRESHOLDS["high"], C.ACTION_HIGH)
            .when(score >= C.THRESHOLDS["default"], C.ACTION_DEFAULT)
            .when(score >= C.THRESHOLDS["low"], C.ACTION_LOW)
            .otherwise(C.ACTION_NONE))


def disruption_type(top_feature: Column) -> Column:
    """Kind of disruption the strongest factor points to; NULL without factors."""
    def named(*parts: str) -> Column:
        hit = F.lit(False)
        for part in parts:
            hit = hit | top_feature.contains(part)
        return hit

    carrier = named("carrier") | F.lower(top_feature).contains("transporte")
    return (F.when(top_feature.isNull(), F.lit(None).cast("string"))
            .when(carrier, "carrier_risk")
            .when(named("region", "comuna"), "zone_risk")
            .when(named("tiempo", "eta"), "delay_risk")
            .when(named("complexity", "transfers"), "routing_risk")
            .when(named("crossdocking"), "crossdock_risk")
            .otherwise("general_risk"))


def direction(contribution: Column) -> Column:
    return F.when(contribution > 0, C.DIRECTION_RAISES).otherwise(C.DIRECTION_LOWERS)


def factor_text(feature: Column, contribution: Column, most_specific: bool = False) -> Column:
    """Readable text of a factor.

    The first key contained in the feature name wins, in declared order, so the
    carrier text also covers the carrier history. ``most_specific`` tries longer
    keys first instead.
    """
    texts = C.FACTOR_TEXTS
    if most_specific:
        texts = sorted(texts, key=lambda item: -len(item[0]))
    subject = F.coalesce(
        *[F.when(feature.contains(key), F.lit(text)) for key, text in texts], feature)
    verb = F.when(contribution > 0, C.RAISES).otherwise(C.LOWERS)
    return F.concat_ws(" ", subject, verb, F.lit(C.RISK_SUFFIX))


def carrier_band(mean_score: Column) -> Column:
    return F.when(mean_score > 70, "red").when(mean_score > 40, "orange").otherwise("teal")


def peak_hour(hour: Column) -> Column:
    return hour.isin(C.PEAK_HOURS)
