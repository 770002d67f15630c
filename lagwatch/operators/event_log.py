"""Event-log aggregates, recency features and quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.dates import hours_between
from ..functions.numeric import cap, floor_at, ratio
from .frequency import value_counts
from .order_stats import exact_quantiles, previous_values

_TIE = ["event_id"]


def _latest(df: DataFrame) -> Column:
    """Sort key of the latest event: time, then event id where there is one."""
    return F.struct("event_timestamp", *[c for c in _TIE if c in df.columns])


def events_per_order(events: DataFrame) -> DataFrame:
    """Event count, first and last time, and the type of the latest event per order; events
    without an order belong to none."""
    return events.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.count("event_type").alias("num_eventos"),
        F.min("event_timestamp").alias("primer_evento_ts"),
        F.max("event_timestamp").alias("ultimo_evento_ts"),
        F.max_by("event_type", _latest(events)).alias("ultimo_tipo"))


def partial_per_order(events: DataFrame) -> DataFrame:
    """The same aggregate in a form that can be merged later."""
    return events.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.count("event_type").alias("num_eventos"),
        F.min("event_timestamp").alias("primer_evento_ts"),
        F.max("event_timestamp").alias("ultimo_evento_ts"),
        F.max(F.struct(_latest(events).alias("at"), F.col("event_type"))).alias("latest"))


def merge_per_order(partials: DataFrame) -> DataFrame:
    return partials.groupBy("order_id").agg(
        F.sum("num_eventos").cast("bigint").alias("num_eventos"),
        F.min("primer_evento_ts").alias("primer_evento_ts"),
        F.max("ultimo_evento_ts").alias("ultimo_evento_ts"),
        F.max("latest")["event_type"].alias("ultimo_tipo"))


def state_code(kind: Column) -> Column:
    """Place of a state in the fixed order of progress; unknown or missing is -1."""
    states = F.array(*[F.lit(s) for s in C.EVENT_STATES])
    return (F.coalesce(F.array_position(states, kind), F.lit(0)) - 1).cast("int")


def recency_features(as_of: Column) -> dict[str, Column]:
    """Recency features of an order joined with its event aggregates."""
    created, promised = F.col("fecha_creacion"), F.col("eta_promised")
    first, last = F.col("primer_evento_ts"), F.col("ultimo_evento_ts")
    elapsed = hours_between(created, last)
    return {
        "tiempo_desde_creacion": elapsed,
        "tiempo_hasta_eta": floor_at(hours_between(last, promised), 0.0),
        "porcentaje_eta_consumido": cap(
            floor_at(ratio(elapsed, hours_between(created, promised)), 0.0), 1.0),
        "tiempo_ultimo_evento": hours_between(last, as_of),
        "velocidad_flujo": ratio(F.col("num_eventos"), hours_between(first, last)),
        "desviacion_vs_itinerario": F.lit(0.0),
        "ultimo_estado_codigo": state_code(F.col("ultimo_tipo")),
    }


def event_gaps(events: DataFrame, silence_hours: float = 72.0) -> DataFrame:
    """Per order: events, silences longer than the limit, and events whose time runs
    backwards in arrival order. Needs ``event_id`` as arrival order."""
    at = F.col("event_timestamp")
    narrow = events.where(F.col("order_id").isNotNull()).select("order_id", "event_id", "event_timestamp")
    in_time = previous_values(narrow, ["event_timestamp", "event_id"], ["event_timestamp"], ["order_id"])
    arrival = previous_values(narrow, ["event_id"], ["event_timestamp"], ["order_id"])
    # the two orders need a sort each, but meet as partial counts in one grouping
    no, gap = F.lit(0).cast("bigint"), hours_between(F.col("event_timestamp_prev"), at)
    silent = in_time.groupBy("order_id").agg(
        F.count("*").alias("events"), F.count_if(gap > silence_hours).alias("silences"),
        F.max(gap).alias("longest_gap_hours"), F.first(no).alias("out_of_order"))
    back = arrival.groupBy("order_id").agg(
        F.first(no).alias("events"), F.first(no).alias("silences"), F.max(F.lit(None).cast("double")).alias("longest_gap_hours"),
        F.count_if(at < F.col("event_timestamp_prev")).alias("out_of_order"))
    return silent.unionByName(back).groupBy("order_id").agg(
        F.sum("events").alias("events"), F.sum("silences").alias("silences"),
        F.max("longest_gap_hours").alias("longest_gap_hours"), F.sum("out_of_order").alias("out_of_order"))


def sessions(events: DataFrame, silence_hours: float = 72.0, stream: bool = False) -> DataFrame:
    """Sessions per order: runs of events without a silence longer than the limit. Events may be in any
    order; those without an order or a time belong to no session.

    Events are first reduced to one row per order and hour (or less, for short limits), which Spark adds up before it
    shuffles, so an order with very many events is no longer a large group. A ``stream`` carries a watermark
    and is not reduced first: a session is given out once it can no longer grow.
    """
    at, known = F.col("event_timestamp"), F.col("order_id").isNotNull() & F.col("event_timestamp").isNotNull()
    silence = F.make_interval(secs=F.lit(silence_hours * 3600))
    if stream:
        first, last, n = F.min("first"), F.max("last"), F.sum("n")
        steps = events.where(known).select("order_id", at.alias("_at"), at.alias("first"), at.alias("last"), F.lit(1).alias("n"))
        window = F.session_window("_at", silence)
    else:
        step = min(3600.0, silence_hours * 3600)
        bucket = F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(int(step * 1_000_000)))
        steps = events.where(known).groupBy("order_id", bucket.alias("_step")).agg(
            F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
        first, last, n = F.min("first"), F.max("last"), F.sum("n")
        length = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / F.lit(1e6)
        window = F.session_window("first", F.make_interval(secs=F.lit(silence_hours * 3600) + length))
    return steps.groupBy("order_id", window.alias("_w")).agg(
        first.alias("session_start"), last.alias("session_end"), n.cast("bigint").alias("events")).drop("_w")


def profile_by_type(events: DataFrame) -> DataFrame:
    return value_counts(events, ["event_type"])


def profile_range(events: DataFrame) -> DataFrame:
    """Events, orders and time range, in one row."""
    return events.agg(
        F.count("*").alias("events"), F.count_distinct("order_id").alias("orders"),
        F.min("event_timestamp").alias("first_event"), F.max("event_timestamp").alias("last_event"))


def profile_per_order(events: DataFrame) -> DataFrame:
    """Distribution of events per order: count, mean, std, min, quartiles, max."""
    sizes = events.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(F.count("*").alias("events"))
    moments = sizes.agg(
        F.count("*").cast("double").alias("count"), F.avg("events").alias("mean"),
        F.stddev_samp("events").alias("std"), F.min("events").cast("double").alias("min"),
        F.max("events").cast("double").alias("max"))
    basic = moments.select(F.expr(
        "stack(5, 'count', `count`, 'mean', `mean`, 'std', `std`, 'min', `min`, 'max', `max`)"
        " AS (statistic, value)"))
    quartiles = exact_quantiles(sizes, F.col("events"), [0.25, 0.5, 0.75]).select(
        F.concat(F.round(F.col("prob") * 100).cast("int").cast("string"), F.lit("%")).alias("statistic"),
        F.col("quantile").alias("value"))
    return basic.unionByName(quartiles)


def event_coverage(packages: DataFrame, events: DataFrame) -> DataFrame:
    """Orders of the dataset that have events, and whether they reach the 70% minimum."""
    orders = packages.select("order_id").where(F.col("order_id").isNotNull()).distinct()
    seen = events.select("order_id", F.lit(True).alias("seen")).distinct()
    joined = orders.alias("l").join(seen.alias("r"), F.col("l.order_id") == F.col("r.order_id"), "left")
    n, hit = F.count("*"), F.count("r.seen")
    return joined.agg(
        n.alias("orders"), hit.alias("matched"), ratio(hit * 100.0, n).alias("match_pct"),
        F.coalesce(ratio(hit * 100.0, n) >= 70, F.lit(False)).alias("enough"))


def unknown_types(events: DataFrame) -> DataFrame:
    """Event types outside the vocabulary, with their counts."""
    return (events.where(F.col("event_type").isNotNull() & ~F.col("event_type").isin(C.EVENT_STATES))
            .groupBy("event_type").agg(F.count("*").alias("n")))
