"""SQL twins of the registered queries, stated straight over the given tables."""

from __future__ import annotations

import re

ORACLE: dict[str, str] = {}


def r(x: str) -> str:
    return f"ROUND(CAST({x} AS DOUBLE), 6) + 0.0"


def t(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def hours(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 3.6e9)"


LOG_FROM = "TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 140 DAY"
EVENTS_AS_OF = "TIMESTAMP '2024-03-01 00:00:00'"

VIEWS: dict[str, str] = {}

VIEWS["base"] = """
SELECT l.*, o_orderdate, o_orderpriority, c_nationkey, n_name, r_name, s_name, p_brand,
       (l_orderkey*7919 + l_partkey*104729 + CAST(l_linenumber AS BIGINT)*1299709 + l_suppkey*15485863) % 1000 AS u
FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"""

VIEWS["pk"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
  'PKG' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
    || CAST(l_quantity AS BIGINT) || '-' || date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS package_id,
  o_orderdate + to_hours(CAST(l_partkey % 24 AS INTEGER)) AS fecha_creacion,
  o_orderdate + INTERVAL 10 DAY AS eta_promised,
  CASE WHEN (l_orderkey + l_linenumber) % 97 <> 0 THEN s_name || CASE WHEN l_suppkey % 10 = 3
    AND o_orderdate >= TIMESTAMP '2000-09-01' THEN '-NEW' ELSE '' END END AS carrier,
  r_name AS region, n_name AS comuna, p_brand || '/' || s_name AS origen,
  o_orderpriority AS metodo_despacho, l_returnflag AS tipo_transporte,
  CASE WHEN late THEN 'Entregada atrasada' WHEN u < 600 THEN 'Entregada antes de tiempo'
       WHEN u < 900 THEN 'Entregada a tiempo' END AS estado_entrega,
  CASE WHEN late THEN 1 + u % 30 WHEN u < 600 THEN -(1 + u % 5) WHEN u < 900 THEN 0 END AS dias_atraso,
  CASE WHEN l_linestatus = 'F' THEN 'SHIPMENT_CONFIRMED' ELSE 'LABELLED' END AS estado_producto,
  CASE WHEN late OR u < 900 THEN 'DELIVERED' ELSE 'IN_TRANSIT' END AS estado_package,
  ((l_partkey*7919 + l_suppkey*104729 + l_orderkey*31) % 1000) / 1000.0::DOUBLE AS risk_score,
  l_orderkey, l_linenumber
FROM (SELECT *, u < 100 + CASE WHEN c_nationkey % 3 = 0 THEN 150 ELSE 0 END + 40*(l_suppkey % 5) AS late FROM base)"""

VIEWS["lab"] = """
SELECT *, CASE WHEN estado_entrega = 'Entregada atrasada' THEN 1 ELSE 0 END AS y,
  isodow(fecha_creacion) - 1 AS wd, hour(fecha_creacion) AS hh, month(fecha_creacion) AS mm,
  CASE WHEN isodow(fecha_creacion) >= 6 THEN 1 ELSE 0 END AS we
FROM pk WHERE estado_entrega IS NOT NULL"""

VIEWS["sp"] = """
SELECT *, CASE WHEN rn < n*67//100 THEN 'train' WHEN rn < n*84//100 THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY fecha_creacion, package_id) - 1 AS rn, count(*) OVER () AS n FROM lab)"""

VIEWS["rc"] = "SELECT carrier, sum(y) AS late, count(*) AS n, avg(y) AS rate FROM sp WHERE split='train' AND carrier IS NOT NULL GROUP BY 1"
VIEWS["rr"] = "SELECT region, sum(y) AS late, count(*) AS n, avg(y) AS rate FROM sp WHERE split='train' AND region IS NOT NULL GROUP BY 1"
VIEWS["rp"] = """SELECT carrier, region, sum(y) AS late, count(*) AS n, avg(y) AS rate FROM sp
WHERE split='train' AND carrier IS NOT NULL AND region IS NOT NULL GROUP BY 1, 2"""
VIEWS["rg"] = "SELECT sum(y) AS late, count(*) AS n, avg(y) AS rate FROM sp WHERE split='train'"


def rated(source: str) -> str:
    return f"""
SELECT q.*, coalesce(rc.rate, g.rate) AS t_carrier, coalesce(rr.rate, g.rate) AS t_region,
  coalesce(rp.rate, g.rate) AS t_pair, g.rate AS g_rate
FROM {source} q CROSS JOIN rg g LEFT JOIN rc ON q.carrier = rc.carrier LEFT JOIN rr ON q.region = rr.region
LEFT JOIN rp ON q.carrier = rp.carrier AND q.region = rp.region"""


VIEWS["fr"] = rated("sp")
VIEWS["pl"] = """
SELECT package_id, order_id, fecha_creacion AS ts, risk_score, carrier, region, comuna,
  CASE WHEN estado_entrega = 'Entregada atrasada' THEN 1 WHEN estado_entrega IS NOT NULL THEN 0 END AS actual,
  isodow(fecha_creacion) - 1 AS wd, hour(fecha_creacion) AS hh, month(fecha_creacion) AS mm FROM pk"""
VIEWS["plr"] = rated("pl")
VIEWS["rec"] = f"SELECT * FROM plr WHERE ts >= {LOG_FROM}"
VIEWS["ll"] = "SELECT risk_score AS s, actual AS y, ts, package_id FROM pl WHERE actual IS NOT NULL"

VIEWS["ops"] = """
SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, s_name, CAST(l_quantity AS INTEGER) AS q,
  l_linenumber % 2 = 0 AS leg,
  l_shipdate + to_hours(CAST(l_partkey % 24 AS INTEGER)) + to_minutes(CAST(l_suppkey % 60 AS INTEGER)) AS st,
  CASE l_suppkey % 3 WHEN 0 THEN 'SELLER' WHEN 1 THEN 'STORE' ELSE 'WAREHOUSE' END AS kind,
  CASE WHEN l_suppkey % 11 <> 0 THEN 'OP' || (l_suppkey % 6) END AS op,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS rn,
  count(*) OVER (PARTITION BY l_orderkey) AS cnt
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""

VIEWS["it0"] = f"""
SELECT o, 'FOFCL' || lpad(CAST(o AS VARCHAR), 12, '0') AS order_id,
  CASE WHEN o % 17 = 0 THEN 'UNKNOWN' ELSE CASE o % 5 WHEN 0 THEN 'MESON' WHEN 1 THEN 'REGULAR'
    WHEN 2 THEN 'DATE_RANGE' WHEN 3 THEN 'TO_CAR' ELSE 'SAME_DAY' END END AS service_category,
  CASE WHEN o % 4 = 1 THEN 'C' || o WHEN o % 3 <> 0 THEN 'T' || o END AS collect_date,
  CASE WHEN o % 2 = 0 THEN 'AM' ELSE 'PM' END AS time_range,
  CASE WHEN o % 5 <> 0 THEN '08:00' END AS time_range_from, CASE WHEN o % 5 <> 0 THEN '13:00' END AS time_range_to,
  count(*) AS num_ops, count(*) FILTER (NOT leg) AS num_processes, count(*) FILTER (leg) AS num_legs,
  count(*) FILTER (leg AND p % 3 = 0) AS num_transfers,
  bool_or(s % 4 = 0) AS has_crossdocking, bool_or(s % 4 = 1) AS has_first_mile,
  count(DISTINCT CASE WHEN s % 4 IN (0, 1) THEN s % 4 END) AS num_logistic_processes,
  CASE WHEN bool_or(leg AND p % 3 = 1) THEN 'HOME_DELIVERY' WHEN bool_or(leg AND p % 3 = 2) THEN 'COLLECT' ELSE 'OTHER' END AS delivery_type,
  arg_min(kind, rn) FILTER (NOT leg) AS origin_node_type, arg_min(s_name, rn) FILTER (NOT leg) AS origin_node_name,
  arg_min('NODE' || (s % 4), rn) FILTER (NOT leg) AS origin_operator,
  arg_max(kind, rn) FILTER (leg) AS dest_node_type, arg_max(s_name, rn) FILTER (leg) AS dest_node_name,
  count(DISTINCT op) AS num_operators, coalesce(string_agg(DISTINCT op, '|' ORDER BY op), '') AS operators_list,
  max(CASE WHEN rn = cnt THEN op END) AS final_carrier,
  round({hours("min(st)", "max(greatest(st, st + to_hours(q)))")}, 2) AS total_span_hours,
  hour(min(st)) AS start_hour,
  CAST(sum(CASE WHEN p % 7 <> 0 THEN q ELSE 0 END) AS DOUBLE) AS total_process_time_mins,
  CAST(arg_min(p % 7 - 1, rn) FILTER (p % 2 = 0) AS DOUBLE) AS picking_window_hours
FROM ops GROUP BY o"""

VIEWS["it"] = """
SELECT *, coalesce(picking_window_hours < 3, false) AS short_picking_window, num_ops >= 8 AS complex_route,
  coalesce(span_ratio > 3, false) AS anomalous_span, coalesce(origin_node_type = 'SELLER', false) AS seller_origin
FROM (SELECT *,
  (num_ops - 2)*10 + CASE WHEN has_crossdocking THEN 15 ELSE 0 END
  + CASE WHEN origin_node_type = 'SELLER' THEN 10 ELSE 0 END + CASE WHEN num_operators >= 2 THEN 5 ELSE 0 END
  + CASE WHEN picking_window_hours < 3 AND picking_window_hours <> 0 THEN 5 ELSE 0 END
  + CASE WHEN num_transfers >= 3 THEN 10 ELSE 0 END AS complexity_score,
  total_span_hours / CASE service_category WHEN 'MESON' THEN 26.0::DOUBLE WHEN 'REGULAR' THEN 34.0::DOUBLE
    WHEN 'DATE_RANGE' THEN 297.0::DOUBLE WHEN 'TO_CAR' THEN 29.0::DOUBLE END AS span_ratio
FROM it0)"""

VIEWS["mp"] = "SELECT 'FOFCL' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS fid, CAST(o_orderkey AS VARCHAR) AS oc FROM orders WHERE o_orderkey % 13 <> 0"
VIEWS["itm"] = "SELECT it.*, mp.oc FROM it JOIN mp ON it.order_id = mp.fid"
ITEM_COLUMNS = ("num_ops, num_processes, num_legs, num_transfers, num_operators, total_span_hours, "
                "picking_window_hours, total_process_time_mins, complexity_score, span_ratio, has_crossdocking, complex_route")
VIEWS["fullset"] = f"SELECT sp.*, {ITEM_COLUMNS} FROM sp LEFT JOIN itm ON sp.order_id = itm.oc"

VIEWS["ev"] = """
SELECT event_id, CAST(user_id AS VARCHAR) AS order_id, ts, CASE event_type WHEN 'signup' THEN 'order_creation'
  WHEN 'view' THEN 'confirmed' WHEN 'click' THEN 'packed' WHEN 'purchase' THEN 'delivered'
  WHEN 'error' THEN 'cancelled' ELSE event_type END AS kind FROM events"""
VIEWS["ea"] = """
SELECT order_id, count(kind) AS num_eventos, min(ts) AS first_ts, max(ts) AS last_ts,
  arg_max(kind, (ts, event_id)) AS ultimo_tipo FROM ev GROUP BY 1"""
VIEWS["hd"] = """
SELECT CAST(user_id AS VARCHAR) AS order_id, min(ts) - INTERVAL 12 HOUR AS created,
  TIMESTAMP '2024-01-20' + to_hours(CAST(user_id AS INTEGER)) AS eta FROM events GROUP BY user_id
UNION ALL SELECT 'N' || c_custkey, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-09' FROM customer"""
VIEWS["he"] = "SELECT hd.*, num_eventos, first_ts, last_ts, ultimo_tipo FROM hd LEFT JOIN ea ON hd.order_id = ea.order_id"

VIEWS["cv"] = """
SELECT s, c, p, sum(c) OVER w AS k, sum(p) OVER w AS tp, sum(c) OVER () AS n, sum(p) OVER () AS pos
FROM (SELECT s, count(*) AS c, sum(y) AS p FROM ll GROUP BY s) WINDOW w AS (ORDER BY s DESC)"""
VIEWS["cp"] = """
SELECT s, tp / k AS prec, CAST(tp AS DOUBLE) / pos AS rec, (k - tp) / (n - pos) AS fpr FROM cv"""


def confusion(source: str, thresholds: list[tuple[str, float]]) -> str:
    return " UNION ALL ".join(f"""
SELECT '{name}' AS name, CAST({x} AS DOUBLE) AS threshold, count(*) FILTER (s >= {x} AND y = 1) AS tp,
  count(*) FILTER (s >= {x} AND y = 0) AS fp, count(*) FILTER (s < {x} AND y = 0) AS tn,
  count(*) FILTER (s < {x} AND y = 1) AS fn FROM {source}""" for name, x in thresholds)


THREE = [("low", 0.3), ("default", 0.5), ("high", 0.7)]
RATES = """coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(fp / nullif(fp + tn, 0), 0) AS fa"""
VIEWS["cm"] = f"SELECT *, {RATES} FROM ({confusion('ll', THREE)})"



def stated_margin(a: str, b: str, c: str, d: str, e: str) -> str:
    """The stated model: rates by carrier, region and pair, weekday and month, as deviations."""
    return f"""(CASE WHEN {a} <= 0.0015::DOUBLE THEN CASE WHEN {d} <= -0.005::DOUBLE THEN -0.25::DOUBLE ELSE 0.125 END
    WHEN {e} <= 0.0005::DOUBLE THEN 0.5 ELSE 0.0625 END
  + CASE WHEN {b} <= -0.0005::DOUBLE THEN -0.25::DOUBLE WHEN {c} <= 0.0105::DOUBLE THEN 0.125 WHEN {b} <= 0.0035::DOUBLE THEN 0.375 ELSE 0.5 END
  + CASE WHEN {d} <= 0.015::DOUBLE THEN -0.25::DOUBLE ELSE 0.5 END + 0.125)"""


VIEWS["dv"] = """SELECT package_id, t_carrier - g_rate AS a, t_region - g_rate AS b, t_pair - g_rate AS c, (wd - 3) / 100.0::DOUBLE AS d,
  (mm - 6) / 1000.0::DOUBLE AS e FROM fr"""
_WITHOUT = [stated_margin(*["0.0::DOUBLE" if k == x else x for x in "abcde"]) for k in "abcde"]
VIEWS["ct"] = f"""
SELECT package_id, unnest(['tasa_fallo_carrier', 'tasa_fallo_region', 'tasa_fallo_carrier_region', 'dia_semana', 'mes']) AS feature,
  unnest([{", ".join(f"m - {w}" for w in _WITHOUT)}]) AS c
FROM (SELECT *, {stated_margin(*"abcde")} AS m FROM dv)"""
VIEWS["ctk"] = "SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY abs(c) DESC, feature) AS pos FROM ct"
VIEWS["cats"] = "SELECT split, 'carrier' AS f, carrier AS v FROM sp UNION ALL SELECT split, 'region', region FROM sp UNION ALL SELECT split, 'comuna', comuna FROM sp"


def sql(name: str, text: str) -> None:
    """Register a query together with the views it needs, in dependency order."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for view in VIEWS:
            if re.search(rf"\b(FROM|JOIN)\s+{view}\b", body) and view not in needed:
                visit(VIEWS[view])
                needed.append(view)

    visit(text)
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed)
    ORACLE[name] = (f"WITH {head} {text}" if head else text).strip()


# --- sources and sinks ------------------------------------------------------------------
sql("s1_packages_load", f"""
SELECT package_id, order_id, carrier, origen, CAST(NULL AS VARCHAR) AS tienda_retiro,
  CASE WHEN l_linenumber <> 7 THEN {t('fecha_creacion')} END AS fecha_creacion,
  {t('fecha_creacion')} AS fecha_estado_package, {t("eta_promised + INTERVAL 18 HOUR")} AS eta_desde,
  CASE l_linenumber % 3 WHEN 0 THEN {t("eta_promised + INTERVAL 18 HOUR")} WHEN 1 THEN {t('eta_promised')} END AS eta_promised,
  CAST(NULL AS VARCHAR) AS fecha_retiro FROM pk""")
sql("s2_itinerary_filter", "SELECT order_id, time_range FROM it0 WHERE o % 101 <> 0")
sql("s3_span_ratio_fill", f"SELECT order_id, {r('coalesce(span_ratio, (SELECT median(span_ratio) FROM it))')} AS span_ratio FROM it")
sql("s4_event_log_load", f"""
SELECT event_id, order_id, kind AS event_type, CASE WHEN event_id % 10 <> 0 THEN {t('ts')} END AS event_timestamp FROM ev""")
sql("s5_recent_predictions", f"""
SELECT count(*) AS n, count(actual) AS labelled, {r('count(actual) * 100.0 / greatest(count(*), 1)')} AS labelled_pct
FROM pl WHERE ts >= {LOG_FROM}""")
sql("s6_lifecycle_items", f"""
SELECT 'FOFCL' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS logistic_order_id, CAST(o_orderkey AS VARCHAR) AS src_order_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'FULFILMENT_ORDER_CREATED' WHEN 1 THEN 'FULFILMENT_ORDER_ITEM_QUANTITY_PACKED'
    ELSE 'FULFILMENT_ORDER_PACKAGES_DISPATCHED' END AS event_kind,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'ACTIVE' END AS order_state,
  CASE WHEN o_orderkey % 3 <> 0 THEN {t('o_orderdate')} END AS event_at,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'PKG' || o_orderkey END AS package_id,
  CASE o_orderkey % 3 WHEN 1 THEN 'PACKED' WHEN 2 THEN 'SHIPMENT_CONFIRMED' END AS package_state,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'MESON' END AS service_category,
  CASE WHEN o_orderkey % 3 <> 0 THEN {t('o_orderdate')} END AS collect_availability,
  'IT' || o_orderkey || x AS item_id, 'SRC' || o_orderkey || x AS src_item_id,
  'SELLER' || (o_orderkey % 10) AS seller_id, 'SKU' || o_orderkey AS sku_id,
  CASE WHEN o_orderkey % 7 <> 0 THEN 1 + o_orderkey % 4 END AS quantity,
  CAST(trunc(o_totalprice) AS DOUBLE) AS unit_value
FROM orders, (SELECT unnest(['a', 'b']) AS x) WHERE x = 'a' OR o_orderkey % 3 <> 0""")
sql("s7_dataset_write", "SELECT package_id, y AS target_incumplimiento, wd AS dia_semana, split FROM sp")
sql("s8_feature_export", f"""
SELECT order_id, service_category, delivery_type, origin_node_type, origin_node_name, origin_operator, dest_node_type,
  final_carrier, num_ops, num_processes, num_legs, num_transfers, has_crossdocking, has_first_mile, num_operators,
  {r('total_span_hours')} AS total_span_hours, picking_window_hours, total_process_time_mins, complexity_score,
  short_picking_window, anomalous_span, complex_route, seller_origin, {r('span_ratio')} AS span_ratio FROM it""")
RATE_TABLE = f"""
SELECT 'carrier' AS level, carrier, CAST(NULL AS VARCHAR) AS region, {big('late')} AS late, n, {r('rate')} AS rate FROM rc
UNION ALL SELECT 'region', NULL, region, {big('late')}, n, {r('rate')} FROM rr
UNION ALL SELECT 'carrier_region', carrier, region, {big('late')}, n, {r('rate')} FROM rp
UNION ALL SELECT 'global', NULL, NULL, {big('late')}, n, {r('rate')} FROM rg"""
sql("s9_rate_table_store", RATE_TABLE)
sql("a4_rates_by_pair", RATE_TABLE)
sql("a3_rates_by_key", f"""
SELECT 'carrier' AS level, carrier AS value, {big('late')} AS late, n, {r('rate')} AS rate FROM rc
UNION ALL SELECT 'region', region, {big('late')}, n, {r('rate')} FROM rr""")


def reference_stats(source: str) -> str:
    """``source`` has columns f and v."""
    probs = ", ".join(f"{i}/19.0::DOUBLE" for i in range(20))
    return f"""
SELECT f AS feature, n, {r('mean')} AS mean, {r('std')} AS std, {r('lo')} AS min, {r('hi')} AS max,
  {big('i')} AS pos, {r('ps[i + 1]')} AS percentile
FROM (SELECT f, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS lo, max(v) AS hi,
        quantile_cont(v, [{probs}]) AS ps FROM ({source}) WHERE v IS NOT NULL GROUP BY f), range(20) AS g(i)"""


def stacked(source: str, pairs: list[tuple[str, str]], where: str = "true") -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS f, CAST({x} AS DOUBLE) AS v FROM {source} WHERE {where}" for name, x in pairs)


CAL = [("dia_semana", "wd"), ("hora_creacion", "hh"), ("mes", "mm")]
sql("s10_reference_stats", reference_stats(stacked(
    "fr", CAL + [("tasa_fallo_carrier", "t_carrier"), ("tasa_fallo_region", "t_region"),
                 ("tasa_fallo_carrier_region", "t_pair")], "split = 'train'")))
sql("d3_raw_feature_stats", reference_stats(stacked(
    "fullset", [(c, c) for c in ("num_ops", "num_transfers", "total_span_hours", "complexity_score")], "split = 'train'")))
sql("s11_metrics_store", " UNION ALL ".join(f"""
SELECT 'run1' AS run, 'test' AS part, name AS threshold_name, '{m}' AS metric, {r(c)} AS value FROM cm"""
    for m, c in [("threshold", "threshold"), ("tp", "tp"), ("fp", "fp"), ("tn", "tn"), ("fn", "fn"),
                 ("precision", "precision"), ("recall", "recall"), ("f1", "f1"), ("tasa_deteccion", "recall"),
                 ("tasa_falsa_alarma", "fa")]))

# --- itinerary parse, projections ---------------------------------------------------------
for _name, _columns in {
    "n1_service_category": "service_category",
    "n2_promise_window": "collect_date, time_range, time_range_from, time_range_to",
    "n3_operation_counts": "num_ops, num_processes, num_legs", "n4_transfers": "num_transfers",
    "n5_logistic_processes": "has_crossdocking, has_first_mile, num_logistic_processes",
    "n6_delivery_type": "delivery_type", "n7_origin_node": "origin_node_type, origin_node_name, origin_operator",
    "n8_destination_node": "dest_node_type, dest_node_name", "n9_operators": "num_operators, operators_list",
    "n10_final_carrier": "final_carrier", "n11_planned_span": f"{r('total_span_hours')} AS total_span_hours, start_hour",
    "n12_process_time": "total_process_time_mins", "n13_picking_window": "picking_window_hours",
}.items():
    sql(_name, f"SELECT order_id, {_columns} FROM it0")
sql("p1_complexity_score", "SELECT order_id, complexity_score FROM it")
sql("p2_span_ratio", f"SELECT order_id, {r('span_ratio')} AS span_ratio FROM it")
sql("p3_route_flags", "SELECT order_id, short_picking_window, complex_route, anomalous_span, seller_origin FROM it")
sql("p4_iso_dates", f"SELECT package_id, CASE WHEN l_linenumber <> 7 THEN {t('fecha_creacion')} END AS parsed FROM pk")
sql("p5_mixed_dates", f"""SELECT package_id, CASE l_linenumber % 3 WHEN 0 THEN {t("eta_promised + INTERVAL 18 HOUR")}
  WHEN 1 THEN {t('eta_promised')} END AS parsed FROM pk""")
sql("p6_creation_time", """SELECT l_linenumber = 7 AS missing, count(*) AS n,
  count(*) FILTER (l_linenumber <> 7) AS same FROM pk GROUP BY 1""")
sql("p7_target", "SELECT package_id, y AS target_incumplimiento FROM lab")
_NULL7 = "CASE WHEN l_linenumber <> 7 THEN {} END AS {}"
_CAL4 = [("isodow(fecha_creacion) - 1", "dia_semana"), ("hour(fecha_creacion)", "hora_creacion"), ("month(fecha_creacion)", "mes")]
sql("p8_calendar", "SELECT package_id, " + ", ".join(_NULL7.format(x, n) for x, n in _CAL4)
    + ", CASE WHEN l_linenumber <> 7 AND isodow(fecha_creacion) >= 6 THEN 1 ELSE 0 END AS es_fin_semana FROM pk")
sql("p9_query_calendar", "SELECT package_id, " + ", ".join(_NULL7.format(x, n) for x, n in _CAL4)
    + ", CASE WHEN l_linenumber <> 7 THEN CASE WHEN isodow(fecha_creacion) >= 6 THEN 1 ELSE 0 END END AS es_fin_semana FROM pk")
_STATES = ["order_creation", "confirmed", "picking", "packed", "dispatch", "in_transit", "out_for_delivery",
           "delivered", "cancelled", "returned"]
_CODE = "CASE ultimo_tipo " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(_STATES)) + " ELSE -1 END"
_USED = f"({hours('created', 'last_ts')} / nullif({hours('created', 'eta')}, 0))"
for _name, _x, _c in [
    ("p10_hours_since_creation", hours("created", "last_ts"), "tiempo_desde_creacion"),
    ("p11_hours_to_promise", f"CASE WHEN {hours('last_ts', 'eta')} < 0 THEN 0 ELSE {hours('last_ts', 'eta')} END", "tiempo_hasta_eta"),
    ("p12_promise_used", f"CASE WHEN {_USED} < 0 THEN 0 WHEN {_USED} > 1 THEN 1 ELSE {_USED} END", "porcentaje_eta_consumido"),
    ("p13_hours_silent", hours("last_ts", EVENTS_AS_OF), "tiempo_ultimo_evento"),
    ("p14_flow_speed", f"num_eventos / nullif({hours('first_ts', 'last_ts')}, 0)", "velocidad_flujo"),
    ("p15_itinerary_deviation", "0.0", "desviacion_vs_itinerario"),
]:
    sql(_name, f"SELECT order_id, {r(_x)} AS {_c} FROM he")
sql("p16_last_state_code", f"SELECT order_id, {_CODE} AS ultimo_estado_codigo FROM he")
sql("p18_confidence", """SELECT package_id, CASE WHEN abs(risk_score - 0.5::DOUBLE) >= 0.3::DOUBLE THEN 'high'
  WHEN abs(risk_score - 0.5::DOUBLE) >= 0.15::DOUBLE THEN 'medium' ELSE 'low' END AS confidence FROM pl""")
sql("p19_action", """SELECT package_id, CASE
  WHEN risk_score >= 0.7 THEN 'ACCIÓN_INMEDIATA: Contactar transportista y notificar cliente'
  WHEN risk_score >= 0.5 THEN 'MONITOREO_ACTIVO: Revisar en próximo ciclo y preparar contingencia'
  WHEN risk_score >= 0.3 THEN 'ALERTA_PREVENTIVA: Marcar para seguimiento manual'
  ELSE 'SIN_ACCIÓN: Orden dentro de parámetros normales' END AS action FROM pl""")
sql("p20_outcome", """SELECT package_id, round(risk_score / 3, 4) AS risk_score, th AS threshold_used,
  CASE WHEN risk_score / 3 >= th THEN 'fail' ELSE 'success' END AS predicted_outcome
FROM (SELECT *, CASE wd WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS th FROM pl)""")
sql("p21_disruption_type", """SELECT package_id, CASE WHEN feature LIKE '%carrier%' THEN 'carrier_risk'
  WHEN feature LIKE '%region%' THEN 'zone_risk' ELSE 'general_risk' END AS disruption_type FROM ctk WHERE pos = 1""")
_VERB = "CASE WHEN c > 0 THEN ' incrementa el riesgo' ELSE ' reduce el riesgo' END"
_FIRST = """CASE feature WHEN 'tasa_fallo_carrier' THEN 'Transportista seleccionado' WHEN 'tasa_fallo_region' THEN 'Región de entrega'
  WHEN 'tasa_fallo_carrier_region' THEN 'Transportista seleccionado' WHEN 'dia_semana' THEN 'Día de la semana' ELSE feature END"""
_BEST = """CASE feature WHEN 'tasa_fallo_carrier' THEN 'Historial del transportista' WHEN 'tasa_fallo_region' THEN 'Historial de la región'
  WHEN 'tasa_fallo_carrier_region' THEN 'Historial del transportista' WHEN 'dia_semana' THEN 'Día de la semana' ELSE feature END"""
sql("p22_factor_text", f"SELECT package_id, feature, {_FIRST} || {_VERB} AS description, {_BEST} || {_VERB} AS specific FROM ct")
sql("p23_carrier_band", """SELECT final_carrier, CASE WHEN m > 70 THEN 'red' WHEN m > 40 THEN 'orange' ELSE 'teal' END AS band
FROM (SELECT final_carrier, avg(complexity_score) AS m FROM it WHERE final_carrier IS NOT NULL GROUP BY 1)""")
sql("p24_peak_hour", "SELECT order_id, start_hour IN (7, 8, 9) AS peak FROM it0")
sql("p25_high_risk_zone", """SELECT service_category, count(*) AS n, count(*) FILTER (picking_window_hours BETWEEN 0 AND 3
  AND complexity_score BETWEEN 60 AND 130) AS in_zone FROM it WHERE picking_window_hours IS NOT NULL GROUP BY 1""")
sql("p26_clipped", f"""SELECT order_id, CASE WHEN picking_window_hours > 3 THEN 3.0::DOUBLE ELSE picking_window_hours END AS window_capped,
  {r('CASE WHEN span_ratio > 15 THEN 15 ELSE span_ratio END')} AS ratio_capped FROM it""")
sql("p27_padded_columns", f"""SELECT c AS "column", CASE c WHEN 'carrier' THEN k WHEN 'es_fin_semana' THEN 0 ELSE n END AS nulls,
  {r("CASE c WHEN 'carrier' THEN k WHEN 'es_fin_semana' THEN 0 ELSE n END * 100.0 / n")} AS pct
FROM (SELECT count(*) AS n, count(*) FILTER (carrier IS NULL) AS k FROM lab),
  (SELECT unnest(['carrier', 'num_ops', 'span_ratio', 'es_fin_semana']) AS c)""")
sql("p28_clean_keys", "SELECT package_id, CASE WHEN carrier IS NOT NULL THEN upper(carrier) || ' X' END AS carrier FROM pk")

# --- joins ----------------------------------------------------------------------------------
sql("j1_event_join", f"""SELECT order_id, num_eventos, {t('first_ts')} AS primer_evento_ts, {t('last_ts')} AS ultimo_evento_ts,
  ultimo_tipo FROM he""")
sql("j2_itinerary_join", f"""SELECT package_id, num_ops, complexity_score, {r('span_ratio')} AS span_ratio
FROM pk LEFT JOIN itm ON pk.order_id = itm.oc""")
sql("j3_rate_lookup", f"SELECT package_id, split, {r('t_carrier')} AS tasa_fallo_carrier, {r('t_region')} AS tasa_fallo_region FROM fr")
sql("j4_pair_rate_lookup", f"SELECT package_id, {r('t_pair')} AS tasa_fallo_carrier_region FROM fr")
VIEWS["sq"] = "SELECT * REPLACE (CASE WHEN l_linenumber <> 6 THEN region END AS region) FROM pk"
VIEWS["sqr"] = rated("sq")
sql("j5_scoring_rate_lookup", f"""SELECT package_id, {r('t_carrier')} AS tasa_fallo_carrier, {r('t_region')} AS tasa_fallo_region,
  {r('t_pair')} AS tasa_fallo_carrier_region FROM sqr""")
sql("j6_category_median_lookup", f"""SELECT order_id, {r('total_span_hours / nullif(m, 0)')} AS span_ratio_computed
FROM it0 LEFT JOIN (SELECT service_category AS sc, median(total_span_hours) AS m FROM it0 GROUP BY 1) ON service_category = sc""")
sql("j7_scalar_share", f"""SELECT comuna, {r('avg(y)')} AS late_rate, {r('avg(y) - (SELECT avg(y) FROM lab)')} AS above_global
FROM lab GROUP BY 1""")
sql("j8_semi_anti", """SELECT 'with_events' AS kind, count(*) AS n FROM hd WHERE order_id IN (SELECT order_id FROM ev)
UNION ALL SELECT 'without_events', count(*) FROM hd WHERE order_id NOT IN (SELECT order_id FROM ev)""")

# --- aggregates --------------------------------------------------------------------------------
_PER_ORDER = f"""SELECT order_id, num_eventos, {t('first_ts')} AS primer_evento_ts, {t('last_ts')} AS ultimo_evento_ts,
  ultimo_tipo FROM ea"""
sql("a1_events_per_order", _PER_ORDER)
sql("st1_event_stream", _PER_ORDER)
sql("a2_global_rate", f"SELECT {r('avg(y)')} AS late_rate FROM lab")
sql("a5_target_balance", f"""SELECT count(*) AS n, {big('sum(y)')} AS late, {big('count(*) - sum(y)')} AS on_time,
  {r('sum(y) * 100.0 / count(*)')} AS late_pct, {r('(count(*) - sum(y)) * 100.0 / count(*)')} AS on_time_pct,
  {r('(count(*) - sum(y)) / greatest(sum(y), 1)')} AS class_weight FROM lab""")


def counted(source: str, *keys: str) -> str:
    k = ", ".join(keys)
    shown = " AND ".join(f"{x} IS NOT NULL" for x in keys)
    return f"""SELECT {k}, count(*) AS n, {r(f'count(*) * 100.0 / (SELECT count(*) FROM {source})')} AS pct
FROM {source} WHERE {shown} GROUP BY {k}"""


for _c in ["service_category", "delivery_type", "origin_node_type", "dest_node_type", "num_operators"]:
    sql(f"a6_count_{_c}", counted("it", _c))
sql("a6_count_crossdock", counted("it", "has_crossdocking"))
sql("a7_operations_histogram", counted("it", "num_ops"))
sql("a7_start_hours", "SELECT start_hour, count(*) AS n, start_hour IN (7, 8, 9) AS peak FROM it0 GROUP BY 1")
sql("a8_service_by_delivery", counted("it", "service_category", "delivery_type"))
sql("a9_span_median", f"SELECT service_category, {r('median(total_span_hours)')} AS median, count(*) AS n FROM it0 GROUP BY 1")
sql("a10_span_percentiles", f"""SELECT service_category, pr AS prob, {r('ps[i]')} AS quantile, n
FROM (SELECT service_category, count(*) AS n, quantile_cont(total_span_hours, [0.25, 0.5, 0.75, 0.9]) AS ps FROM it0
  WHERE service_category IN ('MESON', 'REGULAR', 'DATE_RANGE') GROUP BY 1),
  (SELECT unnest([1, 2, 3, 4]) AS i, unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.9::DOUBLE]) AS pr)""")
sql("a10_sketched_percentiles", """SELECT region, prob, count(*) AS n, TRUE AS within
FROM pl, (SELECT unnest([0.05::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.95::DOUBLE]) AS prob) GROUP BY 1, 2""")
sql("a24_sketched_distincts", """SELECT strftime(ts, '%Y-%m') AS month, count(DISTINCT package_id) AS package_id_exact,
  count(DISTINCT carrier) AS carrier_exact, TRUE AS package_id_within, TRUE AS carrier_within FROM pl GROUP BY 1""")
sql("e2_binned_areas", """SELECT year(ts) AS year, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, TRUE AS pr_auc_within, TRUE AS roc_auc_within
FROM ll GROUP BY 1""")
sql("a11_span_boxes", f"""SELECT service_category, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3,
  {r('least(min(x) FILTER (x BETWEEN lo AND hi), q1)')} AS whisker_low,
  {r('greatest(max(x) FILTER (x BETWEEN lo AND hi), q3)')} AS whisker_high,
  count(*) FILTER (NOT x BETWEEN lo AND hi) AS outliers, count(*) AS n
FROM (SELECT service_category, total_span_hours AS x, q1, median, q3, q1 - 1.5*(q3 - q1) AS lo, q3 + 1.5*(q3 - q1) AS hi
  FROM it0 JOIN (SELECT service_category AS sc, quantile_cont(total_span_hours, 0.25) AS q1, median(total_span_hours) AS median,
    quantile_cont(total_span_hours, 0.75) AS q3 FROM it0 GROUP BY 1) ON service_category = sc
  WHERE service_category IN ('MESON', 'REGULAR', 'DATE_RANGE', 'TO_CAR'))
GROUP BY service_category, q1, median, q3""")
sql("a12_picking_summary", f"""SELECT count(picking_window_hours) AS n, count(*) FILTER (picking_window_hours < 3) AS short,
  {r('count(*) FILTER (picking_window_hours < 3) * 100.0 / count(*)')} AS short_pct,
  {r('median(picking_window_hours)')} AS median FROM it0""")


def histogram(source: str, bins: int, groups: str = "") -> str:
    """``source`` has a column x and the group columns."""
    g = f"{groups}, " if groups else ""
    using = f"USING ({groups}, bin)" if groups else "USING (bin)"
    key = f"GROUP BY {groups}" if groups else ""
    join = f"JOIN rng USING ({groups})" if groups else "CROSS JOIN rng"
    return f"""
SELECT {g}{big('bin')} AS bin, {r('lo + bin * w')} AS low, {r('lo + (bin + 1) * w')} AS high,
  coalesce(c, 0) AS n, {r('coalesce(c, 0) / (total * w)')} AS density
FROM (SELECT *, (hi - lo) / {bins}.0::DOUBLE AS w FROM rng, range({bins}) AS b(bin)) LEFT JOIN (
  SELECT {g}least(floor((x - lo) * {bins}.0::DOUBLE / (hi - lo)), {bins - 1}) AS bin, count(*) AS c
  FROM src {join} GROUP BY {g}bin) {using}""", f"src AS ({source})", f"""rng AS (
  SELECT {g}CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
    CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi, count(*) AS total FROM src {key})"""


def sql_histogram(name: str, source: str, bins: int, groups: str = "") -> None:
    body, src, rng = histogram(source, bins, groups)
    sql(name, f"SELECT * FROM (WITH {src}, {rng} {body})")


sql_histogram("a13_picking_histogram", "SELECT least(picking_window_hours, 100) AS x FROM it WHERE picking_window_hours IS NOT NULL", 40)
sql_histogram("a13_span_ratio_histogram", "SELECT least(span_ratio, 15) AS x FROM it WHERE span_ratio IS NOT NULL", 50)
_COMPARED = ["num_ops", "num_processes", "num_legs", "num_transfers", "total_span_hours", "picking_window_hours",
             "complexity_score", "span_ratio"]
sql_histogram("a23_class_histograms", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, y AS target_incumplimiento, CAST({c} AS DOUBLE) AS x FROM fullset WHERE {c} IS NOT NULL"
    for c in _COMPARED), 30, "feature, target_incumplimiento")
sql("a14_score_histogram", f"""SELECT {big('i')} AS bin, lo AS low, hi AS high,
  count(x) AS n, {r('count(x) * 100.0 / (SELECT count(*) FROM it)')} AS pct
FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i, CAST(unnest([0, 20, 40, 60, 80, 100]) AS DOUBLE) AS lo,
  CAST(unnest([20, 40, 60, 80, 100, 130]) AS DOUBLE) AS hi)
LEFT JOIN (SELECT complexity_score AS x FROM it) ON x >= lo AND (x < hi OR (i = 5 AND x = hi)) GROUP BY 1, 2, 3""")
sql("a15_risk_signals", f"""SELECT signal, n, {r('n * 100.0 / total')} AS pct FROM (SELECT count(*) AS total,
  unnest(['short_picking_window', 'anomalous_span', 'complex_route', 'seller_origin', 'three_operators']) AS signal,
  unnest([count(*) FILTER (short_picking_window), count(*) FILTER (anomalous_span), count(*) FILTER (complex_route),
    count(*) FILTER (seller_origin), count(*) FILTER (num_operators >= 3)]) AS n FROM it)""")
sql("a16_signals_by_origin", " UNION ALL ".join(f"""SELECT '{k}' AS origin_type, '{c}' AS signal,
  {r(f"coalesce(avg(CAST({c} AS INTEGER)) FILTER (origin_node_type = '{k}') * 100, 0)")} AS pct FROM it"""
    for k in ("SELLER", "STORE", "WAREHOUSE") for c in ("short_picking_window", "anomalous_span", "complex_route")))
sql("a17_carrier_score", f"""SELECT final_carrier, {r('m')} AS mean_score, n,
  CASE WHEN m > 70 THEN 'red' WHEN m > 40 THEN 'orange' ELSE 'teal' END AS band,
  {r('(SELECT avg(complexity_score) FROM it)')} AS global_mean
FROM (SELECT final_carrier, avg(complexity_score) AS m, count(complexity_score) AS n FROM it
  WHERE final_carrier IS NOT NULL GROUP BY 1) WHERE n >= 50""")


def _pct(x: str) -> str:
    return r(f"avg(CASE WHEN {x} THEN 1 ELSE 0 END) * 100")


sql("a18_findings", f"""SELECT count(*) AS orders, {_pct("service_category = 'MESON'")} AS meson_pct,
  {_pct("service_category IN ('REGULAR', 'DATE_RANGE')")} AS home_pct, {_pct("delivery_type = 'HOME_DELIVERY'")} AS home_delivery_pct,
  {_pct('seller_origin')} AS seller_pct, {_pct('num_ops = 2')} AS simple_pct, {_pct('num_ops >= 8')} AS complex_pct,
  {_pct('has_crossdocking')} AS crossdock_pct, {_pct('short_picking_window')} AS short_window_pct,
  count(*) FILTER (short_picking_window) AS short_windows, {_pct('anomalous_span')} AS anomalous_pct,
  count(*) FILTER (anomalous_span) AS anomalous_spans,
  {r("avg(complexity_score) FILTER (final_carrier = 'OP1')")} AS "score_OP1",
  {r("avg(complexity_score) FILTER (final_carrier = 'OP2')")} AS "score_OP2" FROM it""")
sql("a19_target_shares", "SELECT y AS target_incumplimiento, round(count(*) / (SELECT count(*) FROM lab), 3) AS share FROM lab GROUP BY 1")
sql("a20_monthly_rate", f"SELECT strftime(fecha_creacion, '%Y-%m') AS month, count(*) AS n, {r('avg(y)')} AS late_rate FROM lab GROUP BY 1")
sql("a21_worst_carriers", f"""SELECT carrier, count(*) AS n, {r('avg(y)')} AS late_rate FROM lab WHERE carrier IS NOT NULL
GROUP BY 1 HAVING count(*) >= 100 ORDER BY avg(y) DESC, carrier LIMIT 10""")
_CORR = [("dia_semana", "wd"), ("hora_creacion", "hh"), ("mes", "mm"), ("es_fin_semana", "we"),
         ("risk_score", "risk_score"), ("dias_atraso", "dias_atraso")]
_CORRS = " UNION ALL ".join(f"SELECT '{n}' AS feature, corr({x}, y) AS v FROM lab" for n, x in _CORR)
sql("a22_correlations", f"SELECT feature, {r('v')} AS corr FROM ({_CORRS})")
sql("a22_strongest_correlations", f"""SELECT feature, {r('v')} AS corr, sign FROM (
  SELECT *, CASE WHEN v > 0 THEN 'positive' ELSE 'negative' END AS sign,
    row_number() OVER (PARTITION BY v > 0 ORDER BY abs(v) DESC, feature) AS k FROM ({_CORRS}) WHERE v <> 0) WHERE k <= 5""")
sql("a24_events_by_type", f"SELECT kind AS event_type, count(*) AS n, {r('count(*) * 100.0 / (SELECT count(*) FROM ev)')} AS pct FROM ev GROUP BY 1")
sql("a24_event_range", f"""SELECT count(*) AS events, count(DISTINCT order_id) AS orders, {t('min(ts)')} AS first_event,
  {t('max(ts)')} AS last_event FROM ev""")
sql("a24_events_per_order_stats", f"""SELECT s AS statistic, {r('v')} AS value FROM (SELECT
  unnest(['count', 'mean', 'std', 'min', 'max', '25%', '50%', '75%']) AS s,
  unnest([count(*)::DOUBLE, avg(n), stddev_samp(n), min(n)::DOUBLE, max(n)::DOUBLE, quantile_cont(n, 0.25), quantile_cont(n, 0.5),
    quantile_cont(n, 0.75)]) AS v FROM (SELECT order_id, count(*) AS n FROM ev GROUP BY 1))""")


def _of(x: str, whole: str) -> str:
    return r(f"count(*) FILTER ({x}) * 100.0 / {whole}")


sql("a25_delivery_overview", f"""SELECT count(*) AS packages, count(DISTINCT order_id) AS orders,
  {_of('estado_entrega IS NOT NULL', 'count(*)')} AS delivered_pct, {_of('estado_entrega IS NULL', 'count(*)')} AS pending_pct,
  {_of("estado_entrega = 'Entregada antes de tiempo'", 'count(estado_entrega)')} AS early_pct,
  {_of("estado_entrega = 'Entregada a tiempo'", 'count(estado_entrega)')} AS on_time_pct,
  {_of("estado_entrega = 'Entregada atrasada'", 'count(estado_entrega)')} AS late_pct FROM pk""")
sql("a26_dispatch_shares", counted("pk", "metodo_despacho"))
sql("a26_transport_shares", counted("pk", "tipo_transporte"))
for _c in ("carrier", "region"):
    sql(f"a27_{_c}_volume", f"SELECT {_c}, count(*) AS packages, {r('avg(actual)')} AS late_rate FROM pl WHERE {_c} IS NOT NULL GROUP BY 1")
sql("a28_days_late", f"SELECT {big('dias_atraso')} AS dias_atraso, count(*) AS n FROM lab WHERE y = 1 GROUP BY 1")
sql("a28_median_days_late", f"SELECT {r('median(dias_atraso)')} AS median, count(*) AS n FROM lab WHERE y = 1")
sql("a29_packages_per_order", f"""SELECT CASE WHEN k >= 3 THEN '3+' ELSE CAST(k AS VARCHAR) END AS packages, count(*) AS orders,
  {r('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct FROM (SELECT order_id, count(*) AS k FROM pk GROUP BY 1) GROUP BY 1""")
sql("a30_null_counts", f"""SELECT c AS "column", v AS nulls, {r('v * 100.0 / n')} AS pct FROM (SELECT count(*) AS n,
  unnest(['order_id', 'carrier', 'estado_entrega', 'dias_atraso']) AS c, unnest([count(*) - count(order_id),
  count(*) - count(carrier), count(*) - count(estado_entrega), count(*) - count(dias_atraso)]) AS v FROM pk)""")
sql("a30_weekly_volume", "SELECT strftime(date_trunc('week', fecha_creacion), '%Y-%m-%d') AS week, count(*) AS n FROM pk GROUP BY 1")
sql("a30_top_states", """SELECT 'producto' AS kind, estado_producto AS state, count(*) AS n FROM pk GROUP BY 2
UNION ALL SELECT 'package', estado_package, count(*) FROM pk GROUP BY 2""")
sql("a30_top_carriers", "SELECT carrier, count(*) AS n FROM pk WHERE carrier IS NOT NULL GROUP BY 1 ORDER BY n DESC, carrier LIMIT 15")
sql("a31_batch_counters", "SELECT count(*) AS total_queries, count(*) FILTER (risk_score >= 0.5) AS high_risk_count FROM pl")
VIEWS["fold"] = """SELECT *, CASE WHEN rn < n - 5*(n//6) THEN -1 ELSE (rn - (n - 5*(n//6))) // (n//6) END AS block FROM (
  SELECT *, row_number() OVER (ORDER BY ts, package_id) - 1 AS rn, count(*) OVER () AS n FROM ll)"""
_FM = "precision recall f1".split()
sql("a32_fold_average", "SELECT " + ", ".join(f"{r(f'avg({m})')} AS {m}, {r(f'stddev_pop({m})')} AS {m}_std" for m in _FM) + f"""
FROM (SELECT *, {RATES} FROM (SELECT block, count(*) FILTER (s >= 0.5 AND y = 1) AS tp, count(*) FILTER (s >= 0.5 AND y = 0) AS fp,
  count(*) FILTER (s < 0.5 AND y = 0) AS tn, count(*) FILTER (s < 0.5 AND y = 1) AS fn FROM fold WHERE block >= 0 GROUP BY 1))""")
sql("a33_split_summary", f"""SELECT split, count(*) AS n_rows, {t('min(fecha_creacion)')} AS first_date,
  {t('max(fecha_creacion)')} AS last_date, {big('sum(y)')} AS positives, {r('sum(y) * 100.0 / count(*)')} AS positive_pct FROM sp GROUP BY 1""")
sql("a34_load_range", f"""SELECT {t('min(fecha_creacion)')} AS first_date, {t('max(fecha_creacion)')} AS last_date,
  count(DISTINCT carrier) AS carriers, count(DISTINCT region) AS regions FROM pk""")
sql("a35_monthly_carrier_rate", f"""SELECT strftime(fecha_creacion, '%Y-%m') AS month, carrier, count(*) AS n, {r('avg(y)')} AS late_rate,
  CASE WHEN avg(y) >= 0.5 THEN 'critical' WHEN avg(y) >= 0.3 THEN 'high' ELSE 'normal' END AS alert
FROM lab WHERE carrier IS NOT NULL GROUP BY 1, 2""")

# --- windows, order, top ------------------------------------------------------------------------
sql("w1_temporal_split", "SELECT package_id, split FROM sp")
sql("w2_row_order_split", """SELECT package_id, CASE WHEN k < n*67//100 THEN 'train' WHEN k < n*84//100 THEN 'val' ELSE 'test' END AS split
FROM (SELECT package_id, row_number() OVER (ORDER BY package_id) - 1 AS k, count(*) OVER () AS n FROM lab)""")
sql("w3_cv_blocks", f"""SELECT package_id, {big('CASE WHEN rn < n - 5*(n//6) THEN -1 ELSE (rn - (n - 5*(n//6))) // (n//6) END')} AS block FROM (
  SELECT package_id, row_number() OVER (ORDER BY fecha_creacion, package_id) - 1 AS rn, count(*) OVER () AS n FROM sp WHERE split = 'train')""")
sql("w4_threshold_curve", f"SELECT {r('s')} AS score, c, {big('p')} AS p, {big('k')} AS k, {big('tp')} AS tp FROM cv")
sql("w5_top_factors", f"SELECT package_id, {big('pos - 1')} AS pos, feature FROM ctk WHERE pos <= 3")
VIEWS["trend"] = """SELECT CAST(ts AS DATE) - CAST(k AS INTEGER) AS start, count(*) AS n, count(actual) AS labelled,
  count(*) FILTER (actual = 1) AS late, count(*) FILTER (actual = 1 AND risk_score >= 0.5) AS caught
FROM pl, range(14) AS g(k) GROUP BY 1"""
sql("w6_sliding_trend", "SELECT strftime(start, '%Y-%m-%d') AS window_start, n, labelled, late, caught FROM trend")
sql("st2_prediction_stream", "SELECT strftime(start, '%Y-%m-%d') AS window_start, n, labelled, late, caught FROM trend")
sql("w7_event_gaps", f"""SELECT order_id, count(*) AS events, count(*) FILTER (gap > 8) AS silences, {r('max(gap)')} AS longest_gap_hours,
  count(*) FILTER (back) AS out_of_order FROM (SELECT order_id,
    {hours('lag(ts) OVER (PARTITION BY order_id ORDER BY ts, event_id)', 'ts')} AS gap,
    ts < lag(ts) OVER (PARTITION BY order_id ORDER BY event_id) AS back FROM ev) GROUP BY 1""")


def reference_sample(source: str) -> str:
    probs = ", ".join(f"{i}/19.0::DOUBLE" for i in range(20))
    return f"""SELECT f, ps[j + 1] + (ps[j + 2] - ps[j + 1]) * (place - j) AS v FROM (
  SELECT f, ps, place, least(CAST(floor(place) AS INTEGER), 18) AS j FROM (
    SELECT f, ps, i * 19.0::DOUBLE / 999.0::DOUBLE AS place FROM (
      SELECT f, quantile_cont(v, [{probs}]) AS ps FROM ({source}) WHERE v IS NOT NULL GROUP BY f), range(1000) AS g(i)))"""


sql("w8_reference_sample", f"""SELECT f AS feature, {r('v')} AS value, count(*) AS n FROM (
{reference_sample(stacked('sp', [('hora_creacion', 'hh'), ('risk_score', 'risk_score')], "split = 'train'"))}) GROUP BY f, v""")
sql("t1_top_carriers", "SELECT final_carrier, count(*) AS n FROM it WHERE final_carrier IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 8")
sql("t1_top_origin_nodes", "SELECT origin_node_name, count(*) AS n FROM it WHERE origin_node_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 12")
sql("t2_carriers_by_score", f"""SELECT final_carrier, {r('avg(complexity_score)')} AS mean_score FROM it WHERE final_carrier IS NOT NULL
GROUP BY 1""")
sql("t3_riskiest", "SELECT package_id, risk_score, actual AS actual_outcome FROM pl ORDER BY risk_score DESC, package_id LIMIT 10")
sql("t4_top_importance", f"SELECT feature, {r('avg(abs(c))')} AS mean_abs FROM ct GROUP BY 1 ORDER BY avg(abs(c)) DESC, feature LIMIT 10")
sql("x3_global_importance", f"SELECT feature, {r('avg(abs(c))')} AS mean_abs FROM ct GROUP BY 1")
sql("x5_tree_contributions", f"SELECT package_id, feature, {r('c')} AS contribution FROM ct")
sql("x5_tree_margins", f"SELECT package_id, {r(stated_margin(*'abcde'))} AS margin FROM dv")
sql("x4_factor_texts", f"""SELECT package_id, {big('pos - 1')} AS pos, feature, round(c, 4) + 0.0 AS shap_value,
  CASE WHEN c > 0 THEN 'incrementa_riesgo' ELSE 'reduce_riesgo' END AS direction, {_FIRST} || {_VERB} AS description
FROM ctk WHERE pos <= 3""")

# --- set operations --------------------------------------------------------------------------------
sql("u1_new_categories", """SELECT DISTINCT f AS "column", v AS value FROM cats WHERE split = 'test' AND v IS NOT NULL
AND (f, v) NOT IN (SELECT f, v FROM cats WHERE split = 'train' AND v IS NOT NULL)""")
sql("u2_event_coverage", f"""SELECT count(*) AS orders, count(e) AS matched, {r('count(e) * 100.0 / count(*)')} AS match_pct,
  count(e) * 100.0 / count(*) >= 70 AS enough FROM (SELECT DISTINCT order_id FROM hd) h
LEFT JOIN (SELECT DISTINCT order_id AS e FROM ev) ON order_id = e""")
sql("u3_unknown_event_types", """SELECT kind || '_x' AS event_type, count(*) AS n FROM ev WHERE event_id % 9 = 0 GROUP BY 1""")
sql("u4_concatenate", f"SELECT split, count(*) AS n, {big('sum(y)')} AS late FROM sp GROUP BY 1")

# --- preparation and model ----------------------------------------------------------------------------
_M1 = [("mes", "mm"), ("num_ops", "num_ops"), ("picking_window_hours", "picking_window_hours"), ("span_ratio", "span_ratio")]
sql("m1_scaled_numbers", "SELECT package_id, " + ", ".join(
    r(f"(coalesce({x}, md_{n}) - av_{n}) / CASE WHEN sd_{n} > 0 THEN sd_{n} ELSE 1 END") + f" AS {n}" for n, x in _M1)
    + " FROM fullset, (SELECT " + ", ".join(f"any_value(m_{n}) AS md_{n}, avg(coalesce({x}, m_{n})) AS av_{n}, stddev_pop(coalesce({x}, m_{n})) AS sd_{n}" for n, x in _M1)
    + " FROM fullset, (SELECT " + ", ".join(f"median(CAST({x} AS DOUBLE)) AS m_{n}" for n, x in _M1)
    + " FROM fullset WHERE split = 'train') WHERE split = 'train')")
_CATS = ["carrier", "region", "comuna", "metodo_despacho", "tipo_transporte", "origen"]
VIEWS["cl"] = " UNION ALL ".join(f"SELECT split, '{c}' AS f, coalesce({c}, 'unknown') AS v FROM sp" for c in _CATS)
VIEWS["lv"] = """SELECT f, v, count(*) AS n, CASE WHEN count(*) >= 10 THEN v ELSE '__infrequent__' END AS level
FROM cl WHERE split = 'train' GROUP BY 1, 2"""
sql("m2_category_levels", "SELECT f AS feature, v AS value, n, level FROM lv")
sql("m2_encoded_rows", """SELECT cl.f AS feature, level, count(*) AS n FROM cl LEFT JOIN lv ON cl.f = lv.f AND cl.v = lv.v
WHERE split = 'test' GROUP BY 1, 2""")
VIEWS["slots"] = """SELECT f, level, row_number() OVER (PARTITION BY f ORDER BY level = '__infrequent__', level) - 1 AS slot,
  count(*) OVER (PARTITION BY f) AS width FROM (SELECT DISTINCT f, level FROM lv)"""
_NUM = CAL + [("tasa_fallo_carrier", "t_carrier"), ("tasa_fallo_region", "t_region"), ("tasa_fallo_carrier_region", "t_pair")]
_FIRST_SLOT = " ".join(f"WHEN '{c}' THEN {len(_NUM)}" + "".join(f" + (SELECT any_value(width) FROM slots WHERE f = '{b}')" for b in _CATS[:i])
                       for i, c in enumerate(_CATS))
VIEWS["scaled"] = "SELECT package_id, split, we, " + ", ".join(
    f"(coalesce({x}, md_{n}) - av_{n}) / CASE WHEN sd_{n} > 0 THEN sd_{n} ELSE 1 END AS z_{n}" for n, x in _NUM) \
    + " FROM fr, (SELECT " + ", ".join(f"any_value(m_{n}) AS md_{n}, avg(coalesce({x}, m_{n})) AS av_{n}, stddev_pop(coalesce({x}, m_{n})) AS sd_{n}" for n, x in _NUM) \
    + " FROM fr, (SELECT " + ", ".join(f"median(CAST({x} AS DOUBLE)) AS m_{n}" for n, x in _NUM) \
    + " FROM fr WHERE split = 'train') WHERE split = 'train')"
_ALL_CATS = " UNION ALL ".join(f"SELECT package_id, split, '{c}' AS f, coalesce({c}, 'unknown') AS v FROM sp" for c in _CATS)
VIEWS["vec"] = " UNION ALL ".join(f"SELECT package_id, split, {i} AS slot, z_{n} AS value FROM scaled" for i, (n, _) in enumerate(_NUM)) + f"""
UNION ALL SELECT package_id, split, CASE c.f {_FIRST_SLOT} END + slot, 1.0::DOUBLE FROM ({_ALL_CATS}) c JOIN lv ON c.f = lv.f AND c.v = lv.v
  JOIN slots ON slots.f = lv.f AND slots.level = lv.level
UNION ALL SELECT package_id, split, {len(_NUM)} + (SELECT sum(width) FROM (SELECT DISTINCT f, width FROM slots)), coalesce(we, 0)::DOUBLE FROM scaled"""
sql("m4_feature_vector", f"SELECT package_id, {big('slot')} AS slot, {r('value')} AS value FROM vec WHERE value <> 0")
VIEWS["late"] = "SELECT c.f, c.v, sum(y) AS late FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS f, coalesce({c}, 'unknown') AS v, y FROM sp WHERE split = 'train'" for c in _CATS) + ") c GROUP BY 1, 2"
VIEWS["lr"] = """SELECT lv.f, lv.v, sum(late) OVER w / sum(n) OVER w AS rate FROM lv JOIN late ON lv.f = late.f AND lv.v = late.v
WINDOW w AS (PARTITION BY lv.f, lv.level)"""
sql("m4_rate_vector", "SELECT s.package_id, " + ", ".join(f"{r(f'z_{n}')} AS {n}" for n, _ in _NUM) + ", "
    + ", ".join(f"{r(f'coalesce(r_{c}.rate, g.rate)')} AS {c}" for c in _CATS) + f""", {r('coalesce(s.we, 0)')} AS es_fin_semana
FROM scaled s JOIN sp USING (package_id), (SELECT avg(y) AS rate FROM sp WHERE split = 'train') g """.replace(
        ", (SELECT avg", " CROSS JOIN (SELECT avg")
    + " ".join(f"LEFT JOIN lr r_{c} ON r_{c}.f = '{c}' AND r_{c}.v = coalesce(sp.{c}, 'unknown')" for c in _CATS))
sql("m5_prepared_splits", f"""SELECT split, count(*) AS n, {big(f"any_value((SELECT {len(_NUM) + 1} + sum(width) FROM (SELECT DISTINCT f, width FROM slots)))")} AS width
FROM sp GROUP BY 1""")
sql("p17_slot_names", " UNION ALL ".join(f"SELECT {big(str(i))} AS position, 'num__{n}' AS name" for i, (n, _) in enumerate(_NUM)) + f"""
UNION ALL SELECT {big(f'CASE f {_FIRST_SLOT} END + slot')}, 'cat__' || f || '_' || level FROM slots
UNION ALL SELECT {big(f'{len(_NUM)} + (SELECT sum(width) FROM (SELECT DISTINCT f, width FROM slots))')}, 'bool__es_fin_semana'""")
sql("m3_boolean_fill", f"""SELECT package_id, {big('coalesce(CAST(has_crossdocking AS INTEGER), 0)')} AS has_crossdocking,
  {big('coalesce(CAST(complex_route AS INTEGER), 0)')} AS complex_route FROM fullset""")
sql("m6_class_weight", f"SELECT {r('(count(*) - sum(y)) / greatest(sum(y), 1)')} AS class_weight FROM sp WHERE split = 'train'")
sql("m9_calibration", f"""SELECT {r('(SELECT s FROM fs ORDER BY f1 DESC, s LIMIT 1)')} AS threshold_f1,
  {r('(SELECT f1 FROM fs ORDER BY f1 DESC, s LIMIT 1)')} AS f1_at_threshold_f1,
  {r('coalesce((SELECT s FROM fs WHERE prec >= 0.7 ORDER BY rec DESC, s LIMIT 1), 0.5)')} AS threshold_recall,
  {r('(SELECT rec FROM fs WHERE prec >= 0.7 ORDER BY rec DESC, s LIMIT 1)')} AS recall_at_threshold_recall,
  {r('(SELECT prec FROM fs WHERE prec >= 0.7 ORDER BY rec DESC, s LIMIT 1)')} AS precision_at_threshold_recall
""".replace("FROM fs", "FROM (SELECT *, 2 * prec * rec / greatest(prec + rec, 1e-8) AS f1 FROM cp)"))
_AP = "(SELECT sum(CAST(p AS DOUBLE) / pos * tp / k) FROM cv)"
sql("m10_targets_met", f"""SELECT name, {r('precision')} AS precision, {r('recall')} AS recall, {r(_AP)} AS pr_auc,
  {_AP} >= 0.75 AS pr_auc_ok, precision >= 0.7 AS precision_ok, recall >= 0.8 AS recall_ok,
  {_AP} >= 0.75 AND precision >= 0.7 AND recall >= 0.8 AS targets_met FROM cm""")

# --- evaluation ---------------------------------------------------------------------------------------
sql("e1_threshold_metrics", f"""SELECT name, threshold, tp, fp, tn, fn, {r('precision')} AS precision, {r('recall')} AS recall,
  {r('f1')} AS f1, {r('recall')} AS tasa_deteccion, {r('fa')} AS tasa_falsa_alarma FROM cm""")
sql("e2_pr_auc", f"SELECT {r(_AP)} AS pr_auc, {big('max(n)')} AS n, {big('max(pos)')} AS positives FROM cv")
sql("e3_roc_auc", f"SELECT {r('sum((c - p) * (tp - p / 2.0::DOUBLE)) / (CAST(max(pos) AS DOUBLE) * max(n - pos))')} AS roc_auc FROM cv")
sql("e4_curve_points", f"SELECT {r('s')} AS score, {r('prec')} AS precision, {r('rec')} AS recall, {r('fpr')} AS fpr FROM cp")
sql("e5_threshold_accepted", "SELECT name, recall >= 0.8 AND precision >= 0.7 AS accepted FROM cm")

# --- drift ----------------------------------------------------------------------------------------------
VIEWS["rl"] = f"SELECT risk_score AS s, actual AS y FROM pl WHERE actual IS NOT NULL AND ts >= {LOG_FROM}"
VIEWS["rcv"] = """SELECT s, c, p, sum(c) OVER w AS k, sum(p) OVER w AS tp, sum(p) OVER () AS pos
FROM (SELECT s, count(*) AS c, sum(y) AS p FROM rl GROUP BY s) WINDOW w AS (ORDER BY s DESC)"""
VIEWS["perf"] = """SELECT *, (0.75 - ap) / 0.75 AS dr FROM (SELECT (SELECT count(*) FROM rl) AS n,
  (SELECT sum(CAST(p AS DOUBLE) / pos * tp / k) FROM rcv) AS ap,
  (SELECT count(*) FILTER (s >= 0.5 AND y = 1) / count(*) FILTER (y = 1) FROM rl) AS rec)"""
sql("d1_performance_drift", f"""SELECT n AS n_labelled, {r('ap')} AS pr_auc, 0.75::DOUBLE AS baseline_pr_auc, {r('dr')} AS pr_auc_drop,
  {r('rec')} AS recall, n >= 100 AND dr > 0.1 AS pr_auc_trigger, n >= 100 AND rec < 0.7 AS recall_trigger,
  n >= 100 AND (dr > 0.1 OR rec < 0.7) AS "trigger" FROM perf""")
_DF = CAL + [("tasa_fallo_carrier", "t_carrier")]
VIEWS["refs"] = reference_sample(stacked("fr", _DF, "split = 'train'"))
VIEWS["mix"] = f"""SELECT f, v, sum(a) AS a, sum(b) AS b FROM (SELECT f, v, 1 AS a, 0 AS b FROM ({stacked('rec', _DF)})
UNION ALL SELECT f, v, 0, 1 FROM refs) WHERE v IS NOT NULL GROUP BY 1, 2"""
_SCALED = "(sqrt(nr * nf / (nr + nf)::DOUBLE) + 0.12 + 0.11 / sqrt(nr * nf / (nr + nf)::DOUBLE)) * ks"
VIEWS["ks"] = """SELECT f, max(abs(ca / ta - cb / tb)) AS ks, max(ta) AS nr, max(tb) AS nf FROM (SELECT f, sum(a) OVER w AS ca, sum(b) OVER w AS cb,
    sum(a) OVER (PARTITION BY f) AS ta, sum(b) OVER (PARTITION BY f) AS tb FROM mix
  WINDOW w AS (PARTITION BY f ORDER BY v)) WHERE ta >= 30 GROUP BY f"""
# the asymptotic value decides as the exact one does, unless it lies at the very limit
VIEWS["dd"] = f"""SELECT *, f IN ('complexity_score', 'num_transfers', 'total_span_hours', 'tasa_fallo_carrier', 'porcentaje_eta_consumido') AS critical,
  z >= 0.2 AND 2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * z * z))) < 0.05 AS drift
FROM (SELECT *, {_SCALED} AS z FROM ks)"""
sql("d2_feature_drift", f"""SELECT f AS feature, {r('ks')} AS ks_stat, {big('nr')} AS n_recent, {big('nf')} AS n_reference, drift, critical FROM dd""")
_NEW = """(SELECT DISTINCT f, v FROM (SELECT 'carrier' AS f, carrier AS v FROM rec UNION ALL SELECT 'region', region FROM rec
  UNION ALL SELECT 'comuna', comuna FROM rec) WHERE v IS NOT NULL
  AND (f, v) NOT IN (SELECT f, v FROM cats WHERE split = 'train' AND v IS NOT NULL))"""
sql("d4_unseen_in_log", f"""SELECT f AS "column", count(*) AS n FROM {_NEW} GROUP BY 1""")

# --- scoring ----------------------------------------------------------------------------------------------
sql("x1_query_features", "SELECT package_id, carrier, region, " + ", ".join(_NULL7.format(x, n) for x, n in _CAL4)
    + f""", CASE WHEN l_linenumber <> 7 THEN CASE WHEN isodow(fecha_creacion) >= 6 THEN 1 ELSE 0 END END AS es_fin_semana,
  CAST(NULL AS BIGINT) AS num_ops, {r('t_carrier')} AS tasa_fallo_carrier, {r('t_region')} AS tasa_fallo_region,
  {r('t_pair')} AS tasa_fallo_carrier_region FROM sqr""")
VIEWS["decision"] = f"""SELECT n AS n_labelled, n >= 100 AND (dr > 0.1 OR rec < 0.7) AS performance_trigger, nc >= 2 AS drift_trigger,
  k > 0 AS category_trigger, nd AS drifted_features, k AS new_values,
  (n >= 100 AND (dr > 0.1 OR rec < 0.7)) OR nc >= 2 OR k > 0 AS should_retrain, concat_ws('; ',
    CASE WHEN n >= 100 AND dr > 0.1 THEN 'PR-AUC cayó ' || printf('%.1f', dr * 100) || '% (> 10.0%)' END,
    CASE WHEN n >= 100 AND rec < 0.7 THEN 'Recall ' || printf('%.3f', rec) || ' < 0.7' END,
    CASE WHEN nc >= 2 THEN 'Drift en features: [' || names || ']' END,
    CASE WHEN k > 0 THEN 'Nuevas categorías: {{' || listed || '}}' END) AS reasons
FROM perf, (SELECT count(*) FILTER (drift) AS nd, count(*) FILTER (drift AND critical) AS nc,
    string_agg(f, ', ' ORDER BY f) FILTER (drift) AS names FROM dd),
  (SELECT coalesce(sum(n), 0) AS k, string_agg(f || ': ' || n, ', ' ORDER BY f) AS listed FROM (SELECT f, count(*) AS n FROM {_NEW} GROUP BY 1))"""
_DECISION = "n_labelled, performance_trigger, drift_trigger, category_trigger, drifted_features, " + big("new_values") + " AS new_values, should_retrain, reasons"
sql("d5_retrain_decision", f"SELECT {_DECISION} FROM decision")
sql("s13_monitor_report", f"SELECT {_DECISION}, '2001-08-01 00:00:00' AS checked_at FROM decision")

# --- joined runs: what does not depend on the trees ------------------------------------------------------
sql("r1_run_sizes", f"""SELECT 'v1_2001-08-01' AS version, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'val') AS val_rows,
  count(*) FILTER (split = 'test') AS test_rows,
  {r("count(*) FILTER (split = 'train' AND y = 0) / greatest(count(*) FILTER (split = 'train' AND y = 1), 1)")} AS class_weight,
  {big(f"any_value((SELECT {len(_NUM) + 1} + sum(width) FROM (SELECT DISTINCT f, width FROM slots)))")} AS features,
  100.0::DOUBLE AS param_trees, 6.0::DOUBLE AS param_depth, 0.1::DOUBLE AS param_step, 0.8::DOUBLE AS param_rows,
  0.8::DOUBLE AS param_columns, 42.0::DOUBLE AS param_seed FROM sp""")
_UNKNOWN = """(SELECT f, v FROM (SELECT DISTINCT 'carrier' AS f, nullif(carrier, '') AS v FROM sq UNION SELECT DISTINCT 'region', nullif(region, '') FROM sq
  UNION SELECT DISTINCT 'comuna', comuna FROM sq) WHERE v IS NOT NULL
  AND (f, v) NOT IN (SELECT f, v FROM cats WHERE split = 'train' AND v IS NOT NULL))"""
sql("r3_monitoring_run", f"""SELECT (SELECT count(*) FROM sp) AS n_labelled, count(*) > 0 AS category_trigger, count(*) AS new_values FROM {_UNKNOWN}""")
ORACLE["s6_lifecycle_files"] = ORACLE["s6_lifecycle_items"]
sql("st1_live_orders", _PER_ORDER)
VIEWS["ss"] = f"""SELECT order_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events FROM (
  SELECT *, sum(CASE WHEN gap <= 8 THEN 0 ELSE 1 END) OVER (PARTITION BY order_id ORDER BY ts, event_id) AS run FROM (
    SELECT *, {hours('lag(ts) OVER (PARTITION BY order_id ORDER BY ts, event_id)', 'ts')} AS gap FROM ev WHERE order_id IS NOT NULL AND ts IS NOT NULL))
GROUP BY order_id, run"""
sql("w7_event_sessions", f"SELECT order_id, {t('session_start')} AS session_start, {t('session_end')} AS session_end, events FROM ss")
sql("st4_session_stream", f"""SELECT order_id, {t('session_start')} AS session_start, {t('session_end')} AS session_end, events FROM ss
WHERE session_end + INTERVAL 8 HOUR <= (SELECT max(ts) - INTERVAL 2 DAY FROM ev)""")
sql("st5_outcome_stream", f"""SELECT package_id, {t('fecha_creacion')} AS timestamp, CASE WHEN estado_entrega IS NOT NULL
  AND eta_promised + to_days(dias_atraso) BETWEEN fecha_creacion AND fecha_creacion + INTERVAL 20 DAY
  THEN CAST(estado_entrega = 'Entregada atrasada' AS BIGINT) END AS actual_outcome FROM pk""")
ORACLE["j1_bucketed_join"] = ORACLE["j1_event_join"]
VIEWS["ql"] = """SELECT *, CASE WHEN event_id % 10 = 0 THEN 'unreadable' WHEN event_id % 11 = 0 THEN 'empty' WHEN event_id % 9 = 0 THEN 'unreadable'
  WHEN event_id % 7 = 0 THEN 'missing: order_id' END AS reason FROM ev"""
sql("s6_usable_lines", "SELECT event_id, order_id, kind AS event_type, length(kind) AS weight FROM ql WHERE reason IS NULL")
sql("s6_quarantine", "SELECT reason, count(*) AS n FROM ql GROUP BY 1")
sql("s12_model_registry", f"""SELECT k AS number, 'v' || k || '_2001-08-0' || k AS version,
  {big(f"(SELECT {len(_NUM) + 1} + sum(width) FROM (SELECT DISTINCT f, width FROM slots))")} AS features, '2001-08-0' || k AS saved_on,
  (SELECT count(*) FROM sp) AS scored FROM range(1, 3) AS g(k)""")
VIEWS["sd"] = """SELECT *, t_carrier - g_rate AS a, t_region - g_rate AS b, t_pair - g_rate AS c,
  CASE WHEN l_linenumber <> 7 THEN (isodow(fecha_creacion) - 1 - 3) / 100.0::DOUBLE END AS d,
  CASE WHEN l_linenumber <> 7 THEN (month(fecha_creacion) - 6) / 1000.0::DOUBLE END AS e FROM sqr"""
VIEWS["sm"] = f"""SELECT *, 1 / (1 + exp(-2 * m)) AS s, list_transform(list_reverse_sort([
    {", ".join(f"struct_pack(o := abs(m - {w}), n := -{k}, f := '{f}')" for k, (f, w) in enumerate(sorted(
        zip(["tasa_fallo_carrier", "tasa_fallo_region", "tasa_fallo_carrier_region", "dia_semana", "mes"], _WITHOUT, strict=True))))}]), lambda x: x.f)[1:3] AS fs
FROM (SELECT *, {stated_margin(*"abcde")} AS m FROM sd)"""
sql("x2_stated_scoring", """SELECT CASE WHEN ok THEN order_id END AS order_id, CASE WHEN ok THEN round(s, 4) + 0.0 ELSE 0.0::DOUBLE END AS risk_score,
  CASE WHEN NOT ok THEN 'error' WHEN s >= 0.5 THEN 'fail' ELSE 'success' END AS predicted_outcome,
  CASE WHEN NOT ok THEN 'low' WHEN abs(s - 0.5) >= 0.3 THEN 'high' WHEN abs(s - 0.5) >= 0.15 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN NOT ok THEN 'processing_error' WHEN fs[1] LIKE '%carrier%' THEN 'carrier_risk' WHEN fs[1] LIKE '%region%' THEN 'zone_risk'
    ELSE 'general_risk' END AS disruption_type,
  CASE WHEN ok THEN array_to_string(fs, ',') ELSE '' END AS contributing_factors,
  CASE WHEN NOT ok THEN 'ERROR: order_id missing' WHEN s >= 0.7 THEN 'ACCIÓN_INMEDIATA: Contactar transportista y notificar cliente'
    WHEN s >= 0.5 THEN 'MONITOREO_ACTIVO: Revisar en próximo ciclo y preparar contingencia'
    WHEN s >= 0.3 THEN 'ALERTA_PREVENTIVA: Marcar para seguimiento manual' ELSE 'SIN_ACCIÓN: Orden dentro de parámetros normales' END AS recommended_action,
  '2001-08-01 00:00:00' AS timestamp, 'stated' AS model_version, 0.5::DOUBLE AS threshold_used
FROM (SELECT *, package_id NOT LIKE '%7' AS ok FROM sm)""")

