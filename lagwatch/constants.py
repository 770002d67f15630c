"""Fixed values of the data contract: names, vocabularies, thresholds, texts.

Everything in this file is data that results must agree on, not logic.
"""

# --- fixed values: package table, source column -> internal column ------------
PACKAGE_COLUMNS = {
    "order_compra": "order_id",
    "producto": "producto",
    "package_id": "package_id",
    "estado_producto": "estado_producto",
    "fecha_estado_producto": "fecha_estado_producto",
    "estado_package": "estado_package",
    "fecha_estado_package": "fecha_estado_package",
    "fecha_pactada_desde": "eta_desde",
    "fecha_pactada_hasta": "eta_promised",
    "fecha_pactada_retiro": "fecha_retiro",
    "comuna": "comuna",
    "region": "region",
    "tienda_retiro": "tienda_retiro",
    "nombre_transporte": "carrier",
    "tipo_transporte": "tipo_transporte",
    "estado_entrega": "estado_entrega",
    "metodo_despacho": "metodo_despacho",
    "origen_despacho": "origen",
}
ISO_DATE_COLUMNS = ["fecha_estado_producto", "fecha_estado_package"]
SERIAL_DATE_COLUMNS = ["eta_desde", "eta_promised", "fecha_retiro"]

# --- fixed values: delivery outcome -------------------------------------------
TARGET = "target_incumplimiento"
LATE_STATES = ["Entregada atrasada"]
ON_TIME_STATES = ["Entregada antes de tiempo", "Entregada a tiempo"]

# --- fixed values: feature lists ----------------------------------------------
CATEGORICAL_FEATURES = [
    "carrier", "region", "comuna", "metodo_despacho", "tipo_transporte", "origen",
]
CALENDAR_FEATURES = ["dia_semana", "hora_creacion", "mes"]
ITINERARY_NUMERIC_FEATURES = [
    "num_ops", "num_processes", "num_legs", "num_transfers", "num_operators",
    "total_span_hours", "picking_window_hours", "total_process_time_mins",
    "complexity_score", "span_ratio",
]
NUMERIC_FEATURES = CALENDAR_FEATURES + ITINERARY_NUMERIC_FEATURES
ITINERARY_BOOLEAN_FEATURES = [
    "has_crossdocking", "has_first_mile", "short_picking_window",
    "anomalous_span", "complex_route", "seller_origin",
]
BOOLEAN_FEATURES = ["es_fin_semana"] + ITINERARY_BOOLEAN_FEATURES
EVENT_FEATURES = [
    "tiempo_desde_creacion", "tiempo_hasta_eta", "porcentaje_eta_consumido",
    "velocidad_flujo", "tiempo_ultimo_evento", "desviacion_vs_itinerario",
    "num_eventos", "ultimo_estado_codigo",
]
RATE_FEATURES = ["tasa_fallo_carrier", "tasa_fallo_region", "tasa_fallo_carrier_region"]

# --- fixed values: itinerary --------------------------------------------------
ORDER_ID_PREFIX = "FOFCL"
ITINERARY_EXPORT_COLUMNS = [
    "order_id", "service_category", "delivery_type",
    "origin_node_type", "origin_node_name", "origin_operator",
    "dest_node_type", "final_carrier",
    "num_ops", "num_processes", "num_legs", "num_transfers",
    "has_crossdocking", "has_first_mile", "num_operators",
    "total_span_hours", "picking_window_hours",
    "total_process_time_mins", "complexity_score",
    "short_picking_window", "anomalous_span",
    "complex_route", "seller_origin", "span_ratio",
]
CATEGORY_MEDIAN_HOURS = {"MESON": 26, "REGULAR": 34, "DATE_RANGE": 297, "TO_CAR": 29}
BOX_CATEGORIES = ["MESON", "REGULAR", "DATE_RANGE", "TO_CAR"]
PERCENTILE_CATEGORIES = ["MESON", "REGULAR", "DATE_RANGE"]
ORIGIN_TYPES = ["SELLER", "STORE", "WAREHOUSE"]
SCORE_EDGES = [0, 20, 40, 60, 80, 100, 130]
PEAK_HOURS = [7, 8, 9]

# --- fixed values: event vocabulary, in order of progress ----------------------
EVENT_STATES = [
    "order_creation", "confirmed", "picking", "packed", "dispatch",
    "in_transit", "out_for_delivery", "delivered", "cancelled", "returned",
]

# --- fixed values: thresholds, split, targets, triggers ------------------------
THRESHOLDS = {"low": 0.3, "default": 0.5, "high": 0.7}
ACTIVE_THRESHOLD = 0.5
DEFAULT_GLOBAL_RATE = 0.2
TRAIN_PERCENT, TRAIN_VAL_PERCENT = 67, 84
CV_FOLDS = 5
MIN_PR_AUC, MIN_PRECISION, MIN_RECALL = 0.75, 0.70, 0.80
PR_AUC_DROP = 0.10
TRIGGER_RECALL = 0.70
KS_P_VALUE = 0.05
WINDOW_DAYS = 14
MIN_LABELLED = 100
MIN_KS_VALUES = 30
REFERENCE_POINTS = 1000
REFERENCE_PERCENTILES = 20
EXACT_KS_VALUES = 10_000  # largest sample whose p-value is exact
CRITICAL_DRIFT_FEATURES = [
    "complexity_score", "num_transfers", "total_span_hours",
    "tasa_fallo_carrier", "porcentaje_eta_consumido",
]
WATCHED_CATEGORIES = ["carrier", "region", "comuna"]

# --- fixed values: booster parameters -----------------------------------------
BOOSTER = {"trees": 100, "depth": 6, "step": 0.1, "rows": 0.8, "columns": 0.8, "seed": 42}
MIN_CATEGORY_COUNT = 10
UNKNOWN = "unknown"

# --- fixed values: texts ------------------------------------------------------
ACTION_HIGH = "ACCIÓN_INMEDIATA: Contactar transportista y notificar cliente"
ACTION_DEFAULT = "MONITOREO_ACTIVO: Revisar en próximo ciclo y preparar contingencia"
ACTION_LOW = "ALERTA_PREVENTIVA: Marcar para seguimiento manual"
ACTION_NONE = "SIN_ACCIÓN: Orden dentro de parámetros normales"

# reasons of a retraining, filled with the figures
REASON_PR_AUC = "PR-AUC cayó %.1f%% (> {limit}%%)"
REASON_RECALL = "Recall %.3f < {limit}"
REASON_DRIFT = "Drift en features: [%s]"
REASON_CATEGORIES = "Nuevas categorías: {{%s}}"

RAISES, LOWERS = "incrementa", "reduce"
DIRECTION_RAISES, DIRECTION_LOWERS = "incrementa_riesgo", "reduce_riesgo"
RISK_SUFFIX = "el riesgo"
FACTOR_TEXTS = [
    ("carrier", "Transportista seleccionado"),
    ("region", "Región de entrega"),
    ("comuna", "Comuna de destino"),
    ("tasa_fallo_carrier", "Historial del transportista"),
    ("tasa_fallo_region", "Historial de la región"),
    ("complexity_score", "Complejidad de la ruta"),
    ("num_transfers", "Cantidad de transbordos"),
    ("total_span_hours", "Ventana total de proceso"),
    ("picking_window_hours", "Ventana de picking"),
    ("has_crossdocking", "Operación con crossdocking"),
    ("dia_semana", "Día de la semana"),
    ("metodo_despacho", "Método de despacho"),
    ("tipo_transporte", "Tipo de transporte"),
    ("porcentaje_eta_consumido", "Porcentaje de ETA consumido"),
    ("tiempo_ultimo_evento", "Tiempo sin actividad"),
    ("desviacion_vs_itinerario", "Desvío vs itinerario"),
]
