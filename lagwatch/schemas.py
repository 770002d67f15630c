"""Declared schemas and the step that fits a frame to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as C


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


STR, DBL, INT, BOOL = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
NTZ = T.TimestampNTZType()
PARTS = T.ArrayType(INT)

# promised-date document of an itinerary; parsed as a map because an absent key
# and an explicit null mean different things
PROMISED = T.MapType(STR, STR)

OPERATION = _struct(
    type=STR, legType=STR, logisticProcess=STR, processType=STR, processTimeInMins=DBL,
    startTime=PARTS, endTime=PARTS,
    node=_struct(type=STR, nodeName=STR, operatorName=STR),
    dispatchNode=_struct(type=STR, nodeName=STR),
    transportOperator=_struct(name=STR),
    timeline=_struct(pickingDeadline=PARTS),
)
OPERATIONS = T.ArrayType(OPERATION)
OPERATION_KEYS = T.ArrayType(T.MapType(STR, STR))

ITINERARY = _struct(order_id=STR, promised_raw=STR, ops_raw=STR)
EVENT_LOG = _struct(order_id=STR, event_type=STR, event_timestamp=NTZ, event_data=STR)

PACKAGES = _struct(**{
    name: NTZ if name in C.ISO_DATE_COLUMNS + C.SERIAL_DATE_COLUMNS else STR
    for name in C.PACKAGE_COLUMNS.values()
})

CONTEXT = _struct(
    region=STR, comuna=STR, carrier=STR, metodo_despacho=STR, tipo_transporte=STR, origen=STR,
    num_ops=INT, num_processes=INT, num_legs=INT, num_transfers=INT, num_operators=INT,
    total_span_hours=DBL, picking_window_hours=DBL, total_process_time_mins=INT,
    complexity_score=INT, span_ratio=DBL,
    has_crossdocking=BOOL, has_first_mile=BOOL, short_picking_window=BOOL,
    anomalous_span=BOOL, complex_route=BOOL, seller_origin=BOOL,
    service_category=STR, delivery_type=STR, origin_node_type=STR,
    dest_node_type=STR, origin_operator=STR,
)
SCORING_QUERY = _struct(
    order_id=STR, source_order_id=STR, package_id=STR, current_status=STR,
    status_history=T.ArrayType(STR), eta_promised=STR, fecha_creacion=STR, context=CONTEXT,
    tiempo_desde_creacion=DBL, tiempo_hasta_eta=DBL, porcentaje_eta_consumido=DBL,
    velocidad_flujo=DBL, tiempo_ultimo_evento=DBL, desviacion_vs_itinerario=DBL,
    num_eventos=INT, ultimo_estado_codigo=INT,
)

_ITEM = _struct(
    logistic_order_item_id=STR, src_item_id=STR, source_item_id=STR, state=STR,
    itinerary_id=STR, orgn_node_id=STR, fulfilmentChannel=STR, fulfilmentMode=STR,
    item_info=_struct(logistic_sku_id=STR, offering_id=STR, seller_id=STR, seller_sku_id=STR,
                      name=STR),
    quantity=_struct(number=STR, unit=STR),
    insurance=_struct(currency=STR, fraction=STR, unit_value=STR),
)
LIFECYCLE = _struct(
    event_attr=_struct(event_id=STR, event_name=STR, event_type=STR, event_tmst=STR, datetime=STR,
                       event_epoch_tmst=STR, timestamp=STR),
    logistic_order_id=STR, src_order_id=STR, source_order_id=STR, state=STR,
    event_crte_tmst=STR, executed_at=STR,
    order_items=T.ArrayType(_ITEM),
    packages=T.ArrayType(_struct(
        package_id=STR, state=STR, origin_node_id=STR,
        promised_date=_struct(service_category=STR, collect_availability_date=STR),
        items=T.ArrayType(_ITEM),
    )),
)

FEATURE_TYPES: dict[str, T.DataType] = {
    **{name: STR for name in C.CATEGORICAL_FEATURES},
    **{name: DBL for name in C.NUMERIC_FEATURES + C.EVENT_FEATURES + C.RATE_FEATURES},
    **{name: BOOL for name in C.BOOLEAN_FEATURES},
}


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Wanted columns the frame lacks, in the wanted order."""
    present = set(df.columns)
    return [name for name in wanted if name not in present]


def conform(df: DataFrame, wanted: dict[str, T.DataType] | T.StructType,
            keep_others: bool = True) -> DataFrame:
    """Add each absent column as a typed NULL; present ones are left as they are."""
    if isinstance(wanted, T.StructType):
        wanted = {field.name: field.dataType for field in wanted.fields}
    absent = missing_columns(df, list(wanted))
    out = df.withColumns({name: F.lit(None).cast(wanted[name]) for name in absent}) if absent else df
    return out if keep_others else out.select(*wanted)


def model_features(columns: list[str]) -> list[str]:
    """Feature columns present, in declared order, each once."""
    declared = (C.CATEGORICAL_FEATURES + C.NUMERIC_FEATURES + C.BOOLEAN_FEATURES
                + C.EVENT_FEATURES)
    present = set(columns)
    return [name for name in dict.fromkeys(declared) if name in present]
