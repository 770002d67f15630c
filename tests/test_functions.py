from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lagwatch import constants as C
from lagwatch import schemas as S
from lagwatch.functions import dates, risk
from lagwatch.functions import numeric as num
from lagwatch.operators.event_log import state_code
from lagwatch.plans.dataset import build_dataset, with_events
from lagwatch.sources.readers import lifecycle_items, load_packages, parse_lifecycle, read_event_log


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", expr(F.col("x"))).orderBy("i").collect()]


def test_mixed_dates(spark):
    got = column(spark, ["45931.75", "2025-10-01", "2025-10-01T18:00:00", "sin fecha", None, "1e9", "12d"], "string",
                 dates.mixed_timestamp)
    assert got == [datetime(2025, 10, 1, 18), datetime(2025, 10, 1), datetime(2025, 10, 1, 18), None, None, None, None]


def test_calendar_of_missing_date(spark):
    df = spark.createDataFrame([("2025-11-01",), (None,)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    rows = df.select(*[v.alias(k) for k, v in dates.calendar(F.col("t")).items()],
                     dates.calendar(F.col("t"), None)["es_fin_semana"].alias("q")).collect()
    assert tuple(rows[0]) == (5, 0, 11, 1, 1)
    assert tuple(rows[1]) == (None, None, None, 0, None)


def test_score_bands_are_inclusive(spark):
    scores = [0.29, 0.3, 0.5, 0.7]
    assert column(spark, scores, "double", risk.action) == [C.ACTION_NONE, C.ACTION_LOW, C.ACTION_DEFAULT, C.ACTION_HIGH]
    assert column(spark, [0.1, 0.3, 0.45, 0.9], "double", lambda x: risk.confidence(x, F.lit(0.5))) == \
        ["high", "medium", "low", "high"]
    assert column(spark, [0.0, None, 0.3], "double", risk.effective_threshold) == [0.5, 0.5, 0.3]


def test_disruption_and_factor_text(spark):
    names = ["cat__tipo_TRANSPORTE", "num__region", "num__tiempo_ultimo_evento", "num_transfers", "has_crossdocking", "mes", None]
    assert column(spark, names, "string", risk.disruption_type) == [
        "carrier_risk", "zone_risk", "delay_risk", "routing_risk", "crossdock_risk", "general_risk", None]
    name = ["num__tasa_fallo_carrier"]
    assert column(spark, name, "string", lambda x: risk.factor_text(x, F.lit(0.1))) == \
        ["Transportista seleccionado incrementa el riesgo"]
    assert column(spark, name, "string", lambda x: risk.factor_text(x, F.lit(-0.1), True)) == \
        ["Historial del transportista reduce el riesgo"]


def test_null_safe_arithmetic(spark):
    assert column(spark, [None, -1.0, 2.0], "double", lambda x: num.floor_at(x, 0.0)) == [None, 0.0, 2.0]
    assert column(spark, [None, 101.0, 2.0], "double", lambda x: num.cap(x, 100)) == [None, 100.0, 2.0]
    assert column(spark, [0.0, 4.0], "double", lambda x: num.ratio(F.lit(1), x)) == [None, 0.25]


def test_state_codes(spark):
    assert column(spark, ["order_creation", "returned", "lost", None], "string", state_code) == [0, 9, -1, -1]


def test_event_features_of_degenerate_orders(spark):
    heads = spark.createDataFrame([("a", "2025-01-01", "2025-01-01"), ("b", "2025-01-01", "2025-01-02")],
                                  "order_id string, c string, e string").select(
        "order_id", F.col("c").cast("timestamp_ntz").alias("fecha_creacion"), F.col("e").cast("timestamp_ntz").alias("eta_promised"))
    events = spark.createDataFrame([("a", "packed", "2025-01-01 12:00:00"), ("a", "packed", "2025-01-01 12:00:00")],
                                   "order_id string, event_type string, t string").withColumn(
        "event_timestamp", F.col("t").cast("timestamp_ntz"))
    rows = {r["order_id"]: r for r in with_events(heads, events, F.lit("2025-01-02").cast("timestamp_ntz")).collect()}
    a, b = rows["a"], rows["b"]
    assert a["porcentaje_eta_consumido"] is None and a["velocidad_flujo"] is None
    assert (a["tiempo_hasta_eta"], a["tiempo_ultimo_evento"], a["num_eventos"]) == (0.0, 12.0, 2)
    assert b["tiempo_hasta_eta"] is None and b["ultimo_estado_codigo"] == -1


def test_load_reports_missing_columns_and_target_drops_pending(spark):
    source = spark.createDataFrame(
        [("1", "p1", "2025-11-01 08:00:00", "Entregada atrasada"), ("2", "p2", "x", "Entregada a tiempo"), ("3", "p3", None, "otro")],
        "order_compra string, package_id string, fecha_estado_producto string, estado_entrega string")
    loaded, missing = load_packages(source)
    assert "origen_despacho" in missing and "carrier" in loaded.columns
    data, features = build_dataset(loaded)
    assert {r["package_id"]: r[C.TARGET] for r in data.collect()} == {"p1": 1, "p2": 0}
    assert features[:3] == ["carrier", "region", "comuna"] and len(features) == len(set(features))


def test_absent_event_log_is_none(spark):
    assert read_event_log(spark, "/tmp/no-such-folder-of-events") is None


def test_conform_keeps_types(spark):
    df = S.conform(spark.range(1), {"a": S.STR, "id": S.DBL})
    assert dict(df.dtypes) == {"id": "bigint", "a": "string"}


def test_lifecycle_shapes(spark):
    docs = ['{"src_order_id":"9","logistic_order_id":"L1","order_items":[{"logistic_order_item_id":"i","quantity":{"number":"2"}}]}',
            '{"event_attr":{"event_type":"PACKED","timestamp":"1754054828333"},"logistic_order_id":"L2","source_order_id":"8",'
            '"packages":[{"package_id":"P","items":[{"source_item_id":"s","insurance":{"unit_value":"31990"}},{}]}]}']
    rows = lifecycle_items(parse_lifecycle(spark.createDataFrame([(d,) for d in docs], "value string"))).collect()
    by_order = {r["logistic_order_id"]: r for r in rows}
    assert len(rows) == 3 and by_order["L1"]["quantity"] == 2 and by_order["L1"]["package_id"] is None
    assert by_order["L2"]["event_at"] == datetime(2025, 8, 1, 13, 27, 8, 333000)
    assert {r["src_item_id"] for r in rows if r["logistic_order_id"] == "L2"} == {"s", None}
