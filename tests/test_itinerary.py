"""Hand-written itinerary documents for every parsing trap."""

import json

import pytest

from lagwatch.plans.itineraries import itinerary_features


def op(kind="PROCESS", **fields):
    return {"type": kind, **fields}


BROKEN_OPERATOR = [
    op(node={"type": "SELLER", "nodeName": "n"}, transportOperator=None, processType="PICKING",
       startTime=[2025, 1, 1, 10, 0], timeline={"pickingDeadline": [2025, 1, 1, 10, 0, 7]},
       endTime=[2025, 13, 1, 0, 0], processTimeInMins=3),
    op("LEG", legType="COLLECT", dispatchNode={"type": "STORE"}, transportOperator={"name": "B"},
       endTime=[2025, 1, 2, 0, 30]),
    op("LEG", transportOperator={"name": "A"}, startTime=[2025, 1, 1, 0]),
]
ROWS = {
    "empty": ("{}", "[]"),
    "nulls": ('{"serviceCategory":null}', "bad"),
    "bad": ("bad", None),
    "object": (None, '{"type":"LEG"}'),
    "operator": ('{"serviceCategory":"MESON","collectAvailabilityDate":"","dateTo":"x"}', json.dumps(BROKEN_OPERATOR)),
    "no_type": ('{"serviceCategory":"SAME_DAY"}', '[{"legType":"COLLECT","transportOperator":{"name":"A"}}]'),
    "empty_node": (None, json.dumps([op(node={}), op(node={"type": "STORE"})])),
    "one": (None, json.dumps([op()])),
}
for name, minutes in {"w0": 0, "w-1": -60, "w2.99": 179, "w3": 180}.items():
    deadline = [2025, 1, 2 if minutes >= 0 else 1, *divmod(minutes % 1440, 60)]
    ROWS[name] = (None, json.dumps([op(processType="PICKING", startTime=[2025, 1, 2, 0, 0],
                                       timeline={"pickingDeadline": deadline}), op()]))


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(k, *v) for k, v in ROWS.items()],
                               "order_id string, promised_raw string, ops_raw string")
    return {strict: {r["order_id"]: r for r in itinerary_features(df, strict).collect()}
            for strict in (False, True)}


def test_service_category_absent_null_bad(parsed):
    rows = parsed[False]
    assert [rows[k]["service_category"] for k in ("empty", "nulls", "bad")] == ["UNKNOWN", None, None]


def test_empty_collect_date_falls_back(parsed):
    assert parsed[False]["operator"]["collect_date"] == "x"


def test_broken_operations_are_null_and_empty_ones_are_zero(parsed):
    rows = parsed[False]
    for key in ("nulls", "bad", "object"):
        assert rows[key]["num_ops"] is None and rows[key]["delivery_type"] is None
        assert rows[key]["complexity_score"] is None
    assert (rows["empty"]["num_ops"], rows["empty"]["delivery_type"]) == (0, "OTHER")
    assert rows["empty"]["total_span_hours"] is None and rows["empty"]["total_process_time_mins"] == 0


def test_null_operator(parsed):
    row = parsed[False]["operator"]
    assert (row["num_operators"], row["operators_list"], row["final_carrier"]) == (2, "A|B", "A")
    assert (row["total_span_hours"], row["start_hour"], row["picking_window_hours"]) == (14.5, 10, 0.0)
    strict = parsed[True]["operator"]
    assert strict["num_ops"] == 3 and strict["origin_node_type"] == "SELLER"
    for name in ("num_operators", "final_carrier", "total_span_hours", "picking_window_hours"):
        assert strict[name] is None


def test_missing_type_stops_a_strict_parse(parsed):
    assert parsed[False]["no_type"]["num_ops"] == 1
    assert parsed[True]["no_type"]["num_ops"] is None and parsed[True]["no_type"]["service_category"] == "SAME_DAY"


def test_empty_node_object_is_no_node(parsed):
    assert parsed[False]["empty_node"]["origin_node_type"] == "STORE"


def test_picking_window_bonus_and_flag(parsed):
    rows = parsed[False]
    assert [rows[k]["complexity_score"] for k in ("w0", "w-1", "w2.99", "w3")] == [0, 5, 5, 0]
    assert [rows[k]["short_picking_window"] for k in ("w0", "w-1", "w2.99", "w3")] == [True, True, True, False]


def test_one_operation_scores_below_zero(parsed):
    assert parsed[False]["one"]["complexity_score"] == -10


def test_category_without_median_has_no_ratio(parsed):
    assert parsed[False]["no_type"]["span_ratio"] is None and parsed[False]["no_type"]["anomalous_span"] is False
