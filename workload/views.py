"""Delivery views over the given tables, for tests and the registered queries.

Every view is a plain DataFrame derivation of the tables; ``oracle.py`` states the
same views independently in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwatch.sources.readers import spread

from .stage import staged

EVENTS_AS_OF = "2024-03-01 00:00:00"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def _base(spark: SparkSession, d: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Line items with order, customer geography, supplier name and part brand.

    No join is hinted: the optimizer broadcasts a side only below its size limit. Orders meet their
    customers first, so that lines, several times as many, move once for both. Lines are dealt over the
    cores by the key of that join, which needs no exchange of its own then.
    """
    lines = spread(table(spark, d, "lineitem"), "l_orderkey") if lineitem is None else lineitem
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    supplier, part = table(spark, d, "supplier"), table(spark, d, "part")
    placed = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
              .join(nation.select("n_nationkey", "n_name", "n_regionkey"),
                    F.col("c_nationkey") == F.col("n_nationkey"))
              .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
              .select("o_orderkey", "o_orderdate", "o_orderpriority", "c_nationkey", "n_name", "r_name"))
    return (lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")))


def packages(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, d, "packages", derive_packages)


def derive_packages(spark: SparkSession, d: str, lineitem: DataFrame | None = None) -> DataFrame:
    """One row per line item as a package with its delivery state."""
    o, p, n, s = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"))
    u = (o * 7919 + p * 104729 + n.cast("bigint") * 1299709 + s * 15485863) % 1000
    late = u < 100 + F.when(F.col("c_nationkey") % 3 == 0, 150).otherwise(0) + 40 * (s % 5)
    state = (F.when(late, "Entregada atrasada").when(u < 600, "Entregada antes de tiempo")
             .when(u < 900, "Entregada a tiempo"))
    days = (F.when(late, 1 + u % 30).when(u < 600, -(1 + u % 5)).when(u < 900, 0))
    created = F.col("o_orderdate") + _hours(p % 24)
    new = (s % 10 == 3) & (F.col("o_orderdate") >= F.lit("2000-09-01").cast("timestamp_ntz"))
    carrier = F.when((o + n) % 97 != 0, F.concat("s_name", F.when(new, "-NEW").otherwise("")))
    day = F.date_diff(F.col("l_shipdate"), F.lit("1995-01-01"))
    key = F.concat(F.lit("PKG"), F.concat_ws("-", o, n, p, s, F.col("l_quantity").cast("bigint"), day))
    return _base(spark, d, lineitem).select(
        o.cast("string").alias("order_id"), key.alias("package_id"), p.cast("string").alias("producto"),
        created.alias("fecha_creacion"), (F.col("o_orderdate") + _hours(F.lit(240))).alias("eta_promised"),
        carrier.alias("carrier"), F.col("r_name").alias("region"), F.col("n_name").alias("comuna"),
        F.concat_ws("/", "p_brand", "s_name").alias("origen"),
        F.col("o_orderpriority").alias("metodo_despacho"), F.col("l_returnflag").alias("tipo_transporte"),
        state.alias("estado_entrega"), days.cast("int").alias("dias_atraso"),
        F.when(F.col("l_linestatus") == "F", "SHIPMENT_CONFIRMED").otherwise("LABELLED").alias("estado_producto"),
        F.when(state.isNotNull(), "DELIVERED").otherwise("IN_TRANSIT").alias("estado_package"),
        ((p * 7919 + s * 104729 + o * 31) % 1000 / 1000.0).alias("risk_score"),
        o.alias("l_orderkey"), n.alias("l_linenumber"))


def source_packages(spark: SparkSession, d: str) -> DataFrame:
    """Packages under source column names, dates as a workbook holds them: ISO text,
    day numbers, and some junk. One source column is absent."""
    p = packages(spark, d)
    n = F.col("l_linenumber")
    iso = F.date_format("fecha_creacion", "yyyy-MM-dd HH:mm:ss")
    serial = F.date_diff("eta_promised", F.lit("1899-12-30")) + F.lit(0.75)
    mixed = (F.when(n % 3 == 0, serial.cast("string")).when(n % 3 == 1, F.date_format("eta_promised", "yyyy-MM-dd"))
             .otherwise("sin fecha"))
    return p.select(
        F.col("order_id").alias("order_compra"), "producto", "package_id", "estado_producto",
        F.when(n == 7, "pendiente").otherwise(iso).alias("fecha_estado_producto"),
        "estado_package", iso.alias("fecha_estado_package"),
        serial.cast("string").alias("fecha_pactada_desde"), mixed.alias("fecha_pactada_hasta"),
        F.lit(None).cast("string").alias("fecha_pactada_retiro"), "comuna", "region",
        F.col("carrier").alias("nombre_transporte"), "tipo_transporte", "estado_entrega", "metodo_despacho",
        F.col("origen").alias("origen_despacho"))


def itineraries(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, d, "itineraries", derive_itineraries)


def with_junk(docs: DataFrame) -> DataFrame:
    """Documents as a workbook holds them: some rows do not carry a genuine id."""
    junk = F.substring("order_id", 6, 12).cast("bigint") % 101 == 0
    return docs.withColumn("order_id", F.when(junk, F.concat(F.lit("XX"), "order_id")).otherwise(F.col("order_id")))


def derive_itineraries(spark: SparkSession, d: str) -> DataFrame:
    """One itinerary document pair per order, as JSON text.

    The lines of an order become its operations. A document is one row by nature;
    the view only builds the text that the parser reads back.
    """
    lines = table(spark, d, "lineitem").join(
        table(spark, d, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))

    def parts(t: Column) -> Column:
        # inside a lambda nothing is shared: the time is made once, not once for each of its five parts
        return F.element_at(F.transform(F.array(t), lambda v: F.array(F.year(v), F.month(v), F.day(v), F.hour(v), F.minute(v))), 1)

    def operation(e: Column) -> Column:
        p, s, q = e["l_partkey"], e["l_suppkey"], e["l_quantity"].cast("int")
        leg = e["l_linenumber"] % 2 == 0
        start = e["l_shipdate"] + F.make_dt_interval(F.lit(0), (p % 24).cast("int"), (s % 60).cast("int"))
        kind = F.when(s % 3 == 0, "SELLER").when(s % 3 == 1, "STORE").otherwise("WAREHOUSE")
        return F.struct(
            F.when(leg, "LEG").otherwise("PROCESS").alias("type"),
            F.when(leg, F.when(p % 3 == 0, "TRANSFER").when(p % 3 == 1, "HOME_DELIVERY").otherwise("COLLECT"))
            .alias("legType"),
            F.when(s % 4 == 0, "CROSS_DOCKING").when(s % 4 == 1, "FIRST_MILE").alias("logisticProcess"),
            F.when(p % 2 == 0, "PICKING").alias("processType"),
            F.when(p % 7 != 0, q).alias("processTimeInMins"),
            parts(start).alias("startTime"), parts(start + _hours(q)).alias("endTime"),
            F.when(~leg, F.struct(kind.alias("type"), e["s_name"].alias("nodeName"),
                                  F.concat(F.lit("NODE"), s % 4).alias("operatorName"))).alias("node"),
            F.when(leg, F.struct(kind.alias("type"), e["s_name"].alias("nodeName"))).alias("dispatchNode"),
            F.when(s % 11 != 0, F.struct(F.concat(F.lit("OP"), s % 6).alias("name"))).alias("transportOperator"),
            F.struct(parts(start + _hours(p % 7 - 1)).alias("pickingDeadline")).alias("timeline"))

    # the columns of a line are what moves; its operation, many times as wide, is made from them in place
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "s_name")
    o = F.col("l_orderkey")
    category = (F.when(o % 5 == 0, "MESON").when(o % 5 == 1, "REGULAR").when(o % 5 == 2, "DATE_RANGE")
                .when(o % 5 == 3, "TO_CAR").otherwise("SAME_DAY"))
    promised = F.struct(
        F.when(o % 17 != 0, category).alias("serviceCategory"),
        F.when(o % 4 == 0, "").when(o % 4 == 1, F.concat(F.lit("C"), o)).alias("collectAvailabilityDate"),
        F.when(o % 3 != 0, F.concat(F.lit("T"), o)).alias("dateTo"),
        F.when(o % 2 == 0, "AM").otherwise("PM").alias("timeRange"),
        F.when(o % 5 != 0, "08:00").alias("timeRangeFrom"), F.when(o % 5 != 0, "13:00").alias("timeRangeTo"))
    docs = lines.groupBy("l_orderkey").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(entry)), operation)).alias("ops_raw"))
    return docs.select(
        F.concat(F.lit("FOFCL"), F.lpad(o.cast("string"), 12, "0")).alias("order_id"),
        F.to_json(promised).alias("promised_raw"), "ops_raw")


def order_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Itinerary id to package order id; every 13th order has no entry."""
    o = F.col("o_orderkey")
    return table(spark, d, "orders").where(o % 13 != 0).select(
        F.concat(F.lit("FOFCL"), F.lpad(o.cast("string"), 12, "0")).alias("order_id"),
        o.cast("string").alias("order_compra"))


_TYPES = {"signup": "order_creation", "view": "confirmed", "click": "packed",
          "purchase": "delivered", "error": "cancelled"}


def map_events(raw: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    named = kind
    for old, new in _TYPES.items():
        named = F.when(kind == old, new).otherwise(named)
    return raw.select(F.col("user_id").cast("string").alias("order_id"), named.alias("event_type"),
                      F.col("ts").alias("event_timestamp"), F.col("props").alias("event_data"), "event_id")


def event_log(spark: SparkSession, d: str) -> DataFrame:
    return map_events(table(spark, d, "events"))


def order_headers(spark: SparkSession, d: str) -> DataFrame:
    """Creation and promise of the orders in the event log, plus orders without events."""
    seen = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first"))
    heads = seen.select(
        F.col("user_id").cast("string").alias("order_id"),
        (F.col("first") - _hours(F.lit(12))).alias("fecha_creacion"),
        (F.lit("2024-01-20").cast("timestamp_ntz") + _hours(F.col("user_id"))).alias("eta_promised"))
    silent = table(spark, d, "customer").select(
        F.concat(F.lit("N"), F.col("c_custkey")).alias("order_id"),
        F.lit("2024-01-05").cast("timestamp_ntz").alias("fecha_creacion"),
        F.lit("2024-01-09").cast("timestamp_ntz").alias("eta_promised"))
    return heads.unionByName(silent)


def prediction_log(spark: SparkSession, d: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Packages as logged predictions; the outcome is open while pending."""
    p = packages(spark, d) if lineitem is None else derive_packages(spark, d, lineitem)
    state = F.col("estado_entrega")
    outcome = F.when(state == "Entregada atrasada", 1).when(state.isNotNull(), 0)
    ts = F.col("fecha_creacion")
    return p.select(
        "order_id", "package_id", ts.alias("timestamp"), "risk_score",
        F.when(F.col("risk_score") >= 0.5, "fail").otherwise("success").alias("predicted_outcome"),
        outcome.alias("actual_outcome"), "carrier", "region", "comuna",
        F.weekday(ts).alias("dia_semana"), F.hour(ts).alias("hora_creacion"), F.month(ts).alias("mes"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes as the carrier reports them: when the package came, and whether that was late."""
    came = F.col("eta_promised") + F.make_dt_interval(F.col("dias_atraso"))
    return packages(spark, d).where(F.col("estado_entrega").isNotNull()).select(
        "package_id", (F.col("estado_entrega") == "Entregada atrasada").cast("int").alias("outcome"), came.alias("outcome_at"))


def scoring_queries(spark: SparkSession, d: str) -> DataFrame:
    """Packages as scoring queries: nested context, dates as text, some bad or missing."""
    from lagwatch.schemas import CONTEXT

    p = packages(spark, d)
    n = F.col("l_linenumber")
    known = ("region", "comuna", "carrier", "metodo_despacho", "tipo_transporte", "origen")
    context = F.struct(*[
        (F.when(n == 6, "").otherwise(F.col(f.name)) if f.name == "region" else F.col(f.name)).alias(f.name)
        if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in CONTEXT.fields])
    created = F.when(n == 7, "sin fecha").otherwise(F.date_format("fecha_creacion", "yyyy-MM-dd'T'HH:mm:ss"))
    return p.select(F.col("order_id"), F.col("package_id"), created.alias("fecha_creacion"),
                    context.alias("context"))


def lifecycle_documents(spark: SparkSession, d: str) -> DataFrame:
    """Order events as JSON text in the three shapes of the lifecycle samples."""
    orders = table(spark, d, "orders")
    o, k = F.col("o_orderkey"), F.col("o_orderkey") % 3
    text = o.cast("string")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    millis = (F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("o_orderdate")) * 1000)
    quantity = F.struct(F.when(o % 7 == 0, "uno").otherwise((1 + o % 4).cast("string")).alias("number"),
                        F.lit("C/U").alias("unit"))
    money = F.struct(F.lit("CLP").alias("currency"), F.lit("1").alias("fraction"),
                     F.col("o_totalprice").cast("bigint").cast("string").alias("unit_value"))
    info = F.struct(F.concat(F.lit("SKU"), text).alias("logistic_sku_id"),
                    F.concat(F.lit("SELLER"), o % 10).alias("seller_id"))

    def item(suffix: str, source: str) -> Column:
        return F.struct(F.concat(F.lit("IT"), text, F.lit(suffix)).alias("logistic_order_item_id"),
                        F.concat(F.lit("SRC"), text, F.lit(suffix)).alias(source),
                        info.alias("item_info"), quantity.alias("quantity"), money.alias("insurance"))

    def package(state: str, source: str, date: Column) -> Column:
        return F.array(F.struct(
            F.concat(F.lit("PKG"), text).alias("package_id"), F.lit(state).alias("state"),
            F.struct(F.lit("MESON").alias("service_category"), date.alias("collect_availability_date"))
            .alias("promised_date"), F.array(item("a", source), item("b", source)).alias("items")))

    lid = F.concat(F.lit("FOFCL"), F.lpad(text, 12, "0")).alias("logistic_order_id")
    created = F.to_json(F.struct(text.alias("src_order_id"), lid, F.array(item("a", "src_item_id")).alias("order_items")))
    packed = F.to_json(F.struct(
        F.struct(F.lit("FULFILMENT_ORDER_ITEM_QUANTITY_PACKED").alias("event_type"), iso.alias("datetime")).alias("event_attr"),
        lid, text.alias("source_order_id"), F.lit("ACTIVE").alias("state"),
        package("PACKED", "source_item_id", iso).alias("packages")))
    sent = F.to_json(F.struct(
        F.struct(F.lit("FULFILMENT_ORDER_PACKAGES_DISPATCHED").alias("event_name"),
                 F.when(o % 2 == 0, F.concat(stamp, F.lit(" UTC"))).alias("event_tmst"),
                 millis.cast("string").alias("event_epoch_tmst")).alias("event_attr"),
        lid, text.alias("src_order_id"), F.lit("ACTIVE").alias("state"),
        package("SHIPMENT_CONFIRMED", "src_item_id", F.concat(stamp, F.lit(" UTC"))).alias("packages")))
    return orders.select(F.when(k == 0, created).when(k == 1, packed).otherwise(sent).alias("value"))
