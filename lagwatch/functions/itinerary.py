"""Features of one itinerary, as column expressions over its two JSON documents.

Nothing is exploded and no Python runs per row: the operations are parsed once
into an array of structs and reduced with higher-order functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas as S
from .dates import hours_between


def parse_promised(raw: Column) -> Column:
    return F.when(F.ltrim(raw).startswith("{"), F.from_json(raw, S.PROMISED))


def parse_operations(raw: Column) -> Column:
    """The operations array; NULL for bad text. The guard is needed because a lone
    object would otherwise be read as an array of one."""
    return F.when(F.ltrim(raw).startswith("["), F.from_json(raw, S.OPERATIONS))


def parse_operation_keys(raw: Column) -> Column:
    """The same array as maps, which tell an absent key from an explicit null."""
    return F.when(F.ltrim(raw).startswith("["), F.from_json(raw, S.OPERATION_KEYS))


def lacks_type(keys: Column) -> Column:
    return F.exists(keys, lambda op: ~F.map_contains_key(op, "type"))


def null_operator(keys: Column) -> Column:
    """Some operation has ``transportOperator`` set to an explicit null."""
    return F.exists(keys, lambda op: F.map_contains_key(op, "transportOperator")
                    & op["transportOperator"].isNull())


def promised_features(promised: Column) -> dict[str, Column]:
    get = promised.getItem
    return {
        "service_category": F.when(F.map_contains_key(promised, "serviceCategory"),
                                   get("serviceCategory"))
                             .when(promised.isNotNull(), F.lit("UNKNOWN")),
        "collect_date": F.coalesce(F.nullif(get("collectAvailabilityDate"), F.lit("")),
                                   get("dateTo")),
        "time_range": get("timeRange"),
        "time_range_from": get("timeRangeFrom"),
        "time_range_to": get("timeRangeTo"),
    }


def _instant(parts: Column) -> Column:
    """``[y, m, d, h, mi, …]`` to a time stamp; short or impossible ones are NULL."""
    made = F.try_make_timestamp_ntz(parts[0], parts[1], parts[2], parts[3], parts[4], F.lit(0))
    return F.when(F.size(parts) >= 5, made)


def _is_process(op: Column) -> Column:
    return op["type"] == "PROCESS"


def _is_leg(op: Column) -> Column:
    return op["type"] == "LEG"


def _count(ops: Column, test: Callable[[Column], Column]) -> Column:
    return F.when(ops.isNotNull(), F.size(F.filter(ops, test)))


def _first(ops: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(ops, test), F.lit(1))


def _last(ops: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(ops, test), F.lit(-1))


def _filled(node: Column, *fields: str) -> Column:
    """An empty object counts as no node."""
    return F.coalesce(*[node[name] for name in fields]).isNotNull()


def _names(ops: Column, get: Callable[[Column], Column]) -> Column:
    """Distinct non-empty values of a field over the operations."""
    return F.array_distinct(F.filter(F.transform(ops, get), lambda x: x.isNotNull() & (x != "")))


def operation_features(ops: Column) -> dict[str, Column]:
    """Counts, flags, nodes and carrier of the parsed operations."""
    def leg_of(kind: str) -> Column:
        return F.exists(ops, lambda op: _is_leg(op) & (op["legType"] == kind))

    processes = _names(ops, lambda op: op["logisticProcess"])
    operators = _names(ops, lambda op: op["transportOperator"]["name"])
    origin = _first(ops, lambda op: _is_process(op)
                    & _filled(op["node"], "type", "nodeName", "operatorName"))["node"]
    dest = _last(ops, lambda op: _is_leg(op)
                 & _filled(op["dispatchNode"], "type", "nodeName"))["dispatchNode"]
    return {
        "num_ops": F.when(ops.isNotNull(), F.size(ops)),
        "num_processes": _count(ops, _is_process),
        "num_legs": _count(ops, _is_leg),
        "num_transfers": _count(ops, lambda op: _is_leg(op) & (op["legType"] == "TRANSFER")),
        "has_crossdocking": F.array_contains(processes, "CROSS_DOCKING"),
        "has_first_mile": F.array_contains(processes, "FIRST_MILE"),
        "num_logistic_processes": F.when(ops.isNotNull(), F.size(processes)),
        "delivery_type": F.when(leg_of("HOME_DELIVERY"), "HOME_DELIVERY")
                          .when(leg_of("COLLECT"), "COLLECT")
                          .when(ops.isNotNull(), "OTHER"),
        "origin_node_type": origin["type"],
        "origin_node_name": origin["nodeName"],
        "origin_operator": origin["operatorName"],
        "dest_node_type": dest["type"],
        "dest_node_name": dest["nodeName"],
        "num_operators": F.when(ops.isNotNull(), F.size(operators)),
        "operators_list": F.array_join(F.array_sort(operators), "|"),
        "final_carrier": F.try_element_at(ops, F.lit(-1))["transportOperator"]["name"],
    }


def time_features(ops: Column) -> dict[str, Column]:
    """Planned span, start hour, process time and picking window.

    Hours made of whole minutes never tie at two decimals, so ``round`` is exact.
    """
    instants = F.filter(
        F.flatten(F.transform(
            ops, lambda op: F.array(_instant(op["startTime"]), _instant(op["endTime"])))),
        lambda t: t.isNotNull())
    first, last = F.array_min(instants), F.array_max(instants)
    pick = _first(ops, lambda op: op["processType"] == "PICKING")
    window = hours_between(_instant(pick["startTime"]), _instant(pick["timeline"]["pickingDeadline"]))
    return {
        "total_span_hours": F.round(hours_between(first, last), 2),
        "start_hour": F.hour(first),
        "total_process_time_mins": F.aggregate(
            ops, F.lit(0.0), lambda acc, op: acc + F.coalesce(op["processTimeInMins"], F.lit(0.0))),
        "picking_window_hours": F.round(window, 2),
    }


# features that come after the operator step, where a strict parse stops
AFTER_OPERATORS = [
    "num_operators", "operators_list", "final_carrier", "total_span_hours", "start_hour",
    "total_process_time_mins", "picking_window_hours",
]


def complexity_score() -> Column:
    """Route complexity over the parsed feature columns.

    A picking window of exactly 0 earns no bonus while a negative one does, and a
    missing operation count leaves the whole score NULL.
    """
    window = F.col("picking_window_hours")

    def bonus(points: int, test: Column) -> Column:
        return F.when(test, points).otherwise(0)

    return ((F.col("num_ops") - 2) * 10
            + bonus(15, F.col("has_crossdocking"))
            + bonus(10, F.col("origin_node_type") == "SELLER")
            + bonus(5, F.col("num_operators") >= 2)
            + bonus(5, (window < 3) & (window != 0))
            + bonus(10, F.col("num_transfers") >= 3))


def span_ratio() -> Column:
    """Planned span over the fixed median of its category; NULL for other categories."""
    median = F.lit(None).cast("double")
    for category, hours in C.CATEGORY_MEDIAN_HOURS.items():
        median = F.when(F.col("service_category") == category, F.lit(float(hours))).otherwise(median)
    return F.col("total_span_hours") / median


def risk_flags() -> dict[str, Column]:
    """Route flags; a comparison with NULL counts as false."""
    def flag(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    return {
        "short_picking_window": flag(F.col("picking_window_hours") < 3),
        "complex_route": flag(F.col("num_ops") >= 8),
        "anomalous_span": flag(F.col("span_ratio") > 3),
        "seller_origin": flag(F.col("origin_node_type") == "SELLER"),
    }
