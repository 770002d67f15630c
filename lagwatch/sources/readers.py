"""Readers: files to frames with declared types and internal names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from .. import schemas as S
from ..functions.dates import iso_timestamp, lifecycle_timestamp, mixed_timestamp
from ..operators.order_stats import exact_medians


def read_table(spark: SparkSession, path: str, kind: str = "parquet",
               schema: T.StructType | None = None) -> DataFrame:
    """A file table. CSV is read as text by header name and cast to the schema, so a
    missing or moved column cannot shift its neighbours and no pass infers types."""
    if kind == "csv":
        text = spark.read.option("header", True).option("multiLine", False).csv(path)
        return cast_to(text, schema) if schema is not None else text
    reader = spark.read.schema(schema) if schema is not None and kind == "json" else spark.read
    frame = reader.format(kind).load(path)
    return S.conform(frame, schema) if schema is not None else frame


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows of a few files dealt over the cores. A file with one row group is read by one task, and
    so is all that follows without a shuffle; a table of as many files as cores stays as it is.
    With the ``key`` of the join that follows the rows are dealt by it, over the session's shuffle
    partitions, and the join moves them no second time."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(key) if key else df.repartition(cores)


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the present columns to the schema, bad values to NULL, and add the rest."""
    kinds = {field.name: field.dataType for field in schema.fields}
    return S.conform(df.select(*[
        F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns]), schema)


def load_packages(source: DataFrame) -> tuple[DataFrame, list[str]]:
    """Package status rows under internal names, dates coerced, with the creation time.

    Absent source columns are reported and added as NULL. The time of the product
    status stands in for the creation time.
    """
    missing = S.missing_columns(source, list(C.PACKAGE_COLUMNS))
    renamed = source.withColumnsRenamed(
        {old: new for old, new in C.PACKAGE_COLUMNS.items() if old not in missing})
    dates = {c: iso_timestamp(F.col(c).cast("string")) for c in C.ISO_DATE_COLUMNS}
    dates |= {c: mixed_timestamp(F.col(c)) for c in C.SERIAL_DATE_COLUMNS}
    present = {c: value for c, value in dates.items() if c in renamed.columns}
    full = S.conform(renamed.withColumns(present) if present else renamed, S.PACKAGES)
    return full.withColumn("fecha_creacion", F.col("fecha_estado_producto")), missing


def load_itineraries(source: DataFrame, prefix: str = C.ORDER_ID_PREFIX) -> DataFrame:
    """Itinerary documents with a genuine order id; headers and junk rows are left out."""
    return S.conform(source, S.ITINERARY, keep_others=False).where(F.col("order_id").startswith(prefix))


def load_itinerary_features(features: DataFrame) -> DataFrame:
    """Exported features with missing span ratios filled by the median ratio."""
    if "span_ratio" not in features.columns:
        return features
    ratio = F.col("span_ratio").cast("double")
    median = exact_medians(features, ratio).select("median").scalar()
    return features.withColumn("span_ratio", F.coalesce(F.when(~F.isnan(ratio), ratio), median))


def load_event_log(source: DataFrame) -> DataFrame:
    """Event rows with parsed time stamps; unreadable times are NULL."""
    typed = source
    if "event_timestamp" in source.columns:
        typed = source.withColumn("event_timestamp", iso_timestamp(F.col("event_timestamp").cast("string")))
    if "order_id" in source.columns:
        typed = typed.withColumn("order_id", F.col("order_id").cast("string"))
    return S.conform(typed, S.EVENT_LOG)


def read_event_log(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame | None:
    """The event log, or None where there is no such path yet."""
    try:
        return load_event_log(read_table(spark, path, kind))
    except Exception as error:  # only "no such path" is a valid absence
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def read_lifecycle(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(S.LIFECYCLE).option("multiLine", multi_line).json(path)


def parse_lifecycle(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lifecycle documents held as text."""
    return lines.select(F.from_json(F.col(column), S.LIFECYCLE).alias("d")).select("d.*")


def lifecycle_items(events: DataFrame) -> DataFrame:
    """One row per item of a creation, packing or dispatch event.

    The three kinds name things differently; each pair of names becomes one column.
    Creation events list their items directly, the others inside packages.
    """
    attr = F.col("event_attr")
    kind = F.coalesce(attr["event_name"], attr["event_type"],
                      F.when(F.col("order_items").isNotNull(), F.lit("FULFILMENT_ORDER_CREATED")))
    head = events.select(
        "logistic_order_id", F.coalesce("src_order_id", "source_order_id").alias("src_order_id"),
        kind.alias("event_kind"), F.col("state").alias("order_state"),
        lifecycle_timestamp(
            F.coalesce(attr["event_tmst"], attr["datetime"], F.col("event_crte_tmst"), F.col("executed_at")),
            F.coalesce(attr["event_epoch_tmst"], attr["timestamp"])).alias("event_at"),
        "order_items", F.explode_outer("packages").alias("p"))
    items = head.withColumn("i", F.explode_outer(F.coalesce(F.col("p.items"), F.col("order_items"))))
    promised = F.col("p.promised_date")
    return items.select(
        "logistic_order_id", "src_order_id", "event_kind", "order_state", "event_at",
        F.col("p.package_id").alias("package_id"), F.col("p.state").alias("package_state"),
        promised["service_category"].alias("service_category"),
        lifecycle_timestamp(promised["collect_availability_date"], F.lit(None).cast("string"))
        .alias("collect_availability"),
        F.col("i.logistic_order_item_id").alias("item_id"),
        F.coalesce("i.src_item_id", "i.source_item_id").alias("src_item_id"),
        F.col("i.item_info.seller_id").alias("seller_id"),
        F.col("i.item_info.logistic_sku_id").alias("sku_id"),
        F.col("i.quantity.number").try_cast("int").alias("quantity"),
        F.col("i.insurance.unit_value").try_cast("decimal(18,2)").alias("unit_value"))
