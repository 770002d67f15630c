"""The registered queries: one per operator, over the delivery views."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwatch import constants as C
from lagwatch import schemas as S
from lagwatch.functions import dates, risk
from lagwatch.functions import numeric as num
from lagwatch.operators import classification as cls
from lagwatch.operators import contributions as con
from lagwatch.operators import drift, event_log, frequency, histograms, joins, order_stats
from lagwatch.operators.forest import Forest, with_contributions
from lagwatch.operators import preparation as prep
from lagwatch.operators import rates as rt
from lagwatch.operators import sketches as sk
from lagwatch.operators import temporal_split as ts
from lagwatch.plans import dataset as ds
from lagwatch.plans import exploration as ex
from lagwatch.plans import itineraries as it
from lagwatch.plans import itinerary_report as rep
from lagwatch.plans import monitoring, runs, scoring, training
from lagwatch.session import scratch_path, store
from lagwatch.sources import quarantine, readers, stores
from lagwatch.streaming import jobs, state

from . import views as V
from .stage import staged, staged_before

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LOG_AS_OF = "2001-08-01 00:00:00"
LOG_DAYS = 140


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: doubles at 6 digits, whole numbers as bigint, times as text."""
    out = []
    for field in df.schema.fields:
        x, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind in ("double", "float"):
            x = F.round(x.cast("double"), 6) + F.lit(0.0)
        elif kind in ("integer", "short", "byte"):
            x = x.cast("bigint")
        elif kind == "decimal":
            x = x.cast("double")
        elif kind.startswith("timestamp"):
            x = F.date_format(x, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            x = F.date_format(x, "yyyy-MM-dd")
        out.append(x.alias(field.name))
    return df.select(*out)


def query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = lambda spark, d: tidy(run(spark, d))
        return run
    return register


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# --- shared inputs ---------------------------------------------------------------
def labelled(s: SparkSession, d: str) -> DataFrame:
    return ds.build_dataset(V.packages(s, d))[0]


def split_live(s: SparkSession, d: str) -> DataFrame:
    return ts.temporal_split(labelled(s, d))


def split_rows(s: SparkSession, d: str) -> DataFrame:
    return staged(s, d, "split", split_live)


def parse_features(s: SparkSession, d: str) -> DataFrame:
    return it.itinerary_features(V.itineraries(s, d))


def features(s: SparkSession, d: str) -> DataFrame:
    """The feature table: parsing is the costly step, so its result is stored once."""
    return staged(s, d, "features", parse_features)


#: Package columns that no query reads from the joined rows: they are not stored a second time.
UNREAD = ["order_id", "producto", "eta_promised", "estado_entrega", "dias_atraso", "estado_producto", "estado_package",
          "risk_score", "l_orderkey", "l_linenumber"]


def joined(s: SparkSession, d: str) -> DataFrame:
    """The labelled dataset with itinerary features."""
    return staged(s, d, "joined", lambda s, d: ds.build_dataset(
        V.packages(s, d), features(s, d), V.order_mapping(s, d))[0].drop(*UNREAD, *C.CATEGORICAL_FEATURES))


_JOINED_CUTS: dict[tuple[str, str], ts.Cuts] = {}


def joined_split(s: SparkSession, d: str) -> DataFrame:
    """The same with its split, a projection of the stored rows; the cuts are found once per session and folder."""
    key, rows = (s.sparkContext.applicationId, d), joined(s, d)
    if key not in _JOINED_CUTS:
        _JOINED_CUTS[key] = ts.split_cuts(rows)
    return ts.assign_split(rows, _JOINED_CUTS[key])


_SPLIT: dict[tuple[str, str], ds.SplitData] = {}


def split_live_data(s: SparkSession, d: str) -> ds.SplitData:
    return ds.split_with_rates(labelled(s, d))


def split_data(s: SparkSession, d: str) -> ds.SplitData:
    """The split dataset with its rates, learnt once per session and folder."""
    key = (s.sparkContext.applicationId, d)
    if key not in _SPLIT:
        data = split_live_data(s, d)
        rows = staged(s, d, "rated", lambda s, d: data.rows)
        _SPLIT[key] = ds.SplitData(rows, data.cuts, data.rates)
    return _SPLIT[key]


def ordered_events(s: SparkSession, d: str) -> DataFrame:
    return ds.with_events(V.order_headers(s, d), V.event_log(s, d), at(V.EVENTS_AS_OF))


_BUCKETED: dict[tuple[str, str], tuple[str, str]] = {}


def bucketed_orders(s: SparkSession, d: str, buckets: int = 8) -> tuple[DataFrame, DataFrame]:
    """Order headers and their events, stored in buckets by order, once per session."""
    key = (s.sparkContext.applicationId, d)
    if key not in _BUCKETED:
        names = tuple(f"{kind}_{uuid.uuid4().hex}" for kind in ("heads", "events"))
        for name, rows in zip(names, (V.order_headers(s, d), V.event_log(s, d)), strict=True):
            stores.write_bucketed(rows, name, ["order_id"], scratch_path(s, name), buckets)
        _BUCKETED[key] = names
    heads, events = _BUCKETED[key]
    return s.table(heads), s.table(events)


def log_labelled(s: SparkSession, d: str) -> DataFrame:
    return V.prediction_log(s, d).where(F.col("actual_outcome").isNotNull())


def curve(s: SparkSession, d: str) -> DataFrame:
    return cls.score_curve(log_labelled(s, d), "risk_score", "actual_outcome")


#: A small boosted model that any engine can state: nodes (id, feature, threshold, left, right, value) by tree.
STATED_FEATURES = [*C.RATE_FEATURES, "dia_semana", "mes"]
STATED_TREES = [
    [(0, 0, 0.0015, 1, 4, 0.0), (1, 3, -0.005, 2, 3, 0.0), (2, -1, 0, 0, 0, -0.25), (3, -1, 0, 0, 0, 0.125),
     (4, 4, 0.0005, 5, 6, 0.0), (5, -1, 0, 0, 0, 0.5), (6, -1, 0, 0, 0, 0.0625)],
    [(0, 1, -0.0005, 1, 2, 0.0), (1, -1, 0, 0, 0, -0.5), (2, 2, 0.0105, 3, 4, 0.0), (3, -1, 0, 0, 0, 0.25),
     (4, 1, 0.0035, 5, 6, 0.0), (5, -1, 0, 0, 0, 0.75), (6, -1, 0, 0, 0, 1.0)],
    [(0, 3, 0.015, 1, 2, 0.0), (1, -1, 0, 0, 0, -1.0), (2, -1, 0, 0, 0, 2.0)],
    [(0, -1, 0, 0, 0, 0.125)],
]
STATED_WEIGHTS = [1.0, 0.5, 0.25, 1.0]


class StatedPreparer:
    """Deviations of the rates and small calendar effects as the features of the stated model."""

    raw_features = STATED_FEATURES

    def __init__(self, base: float) -> None:
        self.base = base

    def transform(self, df: DataFrame, salt_by: str | None = None) -> DataFrame:
        return df.withColumn("features", F.array(
            *[F.col(c) - F.lit(self.base) for c in C.RATE_FEATURES], (F.col("dia_semana") - 3) / F.lit(100.0), (F.col("mes") - 6) / F.lit(1000.0)))


class StatedModel:
    """The stated trees in the place of a trained model: scoring goes the same way, and SQL can follow it."""

    version, forest = "stated", Forest.of(STATED_TREES, STATED_WEIGHTS)

    def __init__(self, rates: rt.Rates) -> None:
        self.rates, self.preparer = rates, StatedPreparer(rates.global_rate or C.DEFAULT_GLOBAL_RATE)

    def score(self, prepared: DataFrame) -> DataFrame:
        rows = with_contributions(prepared, self.forest, [0.0] * len(STATED_FEATURES), x="features", output="_c", margin="margin").drop("_c")
        return rows.withColumn("risk_score", 1 / (1 + F.exp(-2 * F.col("margin"))))

    def explained(self, prepared: DataFrame, typical: dict[str, object]) -> DataFrame:
        return with_contributions(prepared, self.forest, [float(typical[c]) for c in STATED_FEATURES], x="features").drop("features")


def stated_contributions(s: SparkSession, d: str) -> DataFrame:
    """Margins and contributions of the stated model for every row; the typical row has none."""
    data = split_data(s, d)
    rows = StatedModel(data.rates).preparer.transform(data.rows).select("package_id", "features")
    return with_contributions(rows, StatedModel.forest, [0.0] * len(STATED_FEATURES), x="features", margin="margin")


def contributions(s: SparkSession, d: str) -> DataFrame:
    return con.long_contributions(stated_contributions(s, d), "package_id", STATED_FEATURES)


def stated_factors(s: SparkSession, d: str, k: int = 3) -> DataFrame:
    return stated_contributions(s, d).select(
        "package_id", con.row_factors(F.col("contributions"), STATED_FEATURES, k).alias("contributing_factors"))


# --- sources and sinks -------------------------------------------------------------
@query("s1_packages_load")
def _(s, d):
    loaded, _ = readers.load_packages(V.source_packages(s, d))
    return loaded.select("package_id", "order_id", "carrier", "origen", "tienda_retiro",
                         "fecha_creacion", "fecha_estado_package", "eta_desde", "eta_promised", "fecha_retiro")


@query("s2_itinerary_filter")
def _(s, d):
    return readers.load_itineraries(V.with_junk(V.itineraries(s, d))).select(
        "order_id", F.get_json_object("promised_raw", "$.timeRange").alias("time_range"))


@query("s3_span_ratio_fill")
def _(s, d):
    return readers.load_itinerary_features(features(s, d)).select("order_id", "span_ratio")


@query("s4_event_log_load")
def _(s, d):
    raw = V.event_log(s, d).withColumn("event_timestamp", F.when(
        F.col("event_id") % 10 == 0, "??").otherwise(F.col("event_timestamp").cast("string")))
    return readers.load_event_log(raw).select("event_id", "order_id", "event_type", "event_timestamp")


@query("s5_recent_predictions")
def _(s, d):
    return drift.label_coverage(drift.recent_rows(V.prediction_log(s, d), at(LOG_AS_OF), LOG_DAYS))


@query("s6_lifecycle_items")
def _(s, d):
    return readers.lifecycle_items(readers.parse_lifecycle(V.lifecycle_documents(s, d)))


@query("s6_lifecycle_files")
def _(s, d):
    """The same events, landed as JSON files, one event a line."""
    folder = scratch_path(s, "lifecycle")
    V.lifecycle_documents(s, d).select("value").write.text(folder)
    return readers.lifecycle_items(readers.read_lifecycle(s, folder, multi_line=False))


def quarantined(s: SparkSession, d: str) -> quarantine.Loaded:
    """Event lines, some of them cut short, without an order or with words where a number belongs."""
    i = F.col("event_id")
    fields = ["event_id", F.when(i % 7 != 0, F.col("order_id")).alias("order_id"), "event_type"]
    line = F.when(i % 9 == 0, F.to_json(F.struct(*fields, F.lit("late").alias("weight")))).otherwise(
        F.to_json(F.struct(*fields, F.length("event_type").alias("weight"))))
    lines = V.event_log(s, d).select(F.when(i % 10 == 0, F.substring(line, 1, 14)).when(i % 11 == 0, "  ").otherwise(line).alias("value"))
    schema = T.StructType.fromDDL("event_id long, order_id string, event_type string, weight int")
    return quarantine.load_lines(lines, schema, required=["event_id", "order_id"])


@query("s6_usable_lines")
def _(s, d):
    return quarantined(s, d).rows


@query("s6_quarantine")
def _(s, d):
    return quarantined(s, d).counts()


@query("s7_dataset_write")
def _(s, d):
    path = scratch_path(s, "dataset")
    stores.write_dataset(split_rows(s, d).select("package_id", C.TARGET, "dia_semana", "split"), path)
    return s.read.parquet(path)


@query("s8_feature_export")
def _(s, d):
    return it.export_features(parse_features(s, d))


@query("s9_rate_table_store")
def _(s, d):
    data = split_data(s, d)
    path = scratch_path(s, "rates")
    data.rates.save(path)
    return rt.load_rates(s, path).table


@query("s10_reference_stats")
def _(s, d):
    train = split_data(s, d).part("train")
    stats = drift.reference_stats(train, C.CALENDAR_FEATURES + C.RATE_FEATURES)
    return stats.select("feature", "n", "mean", "std", "min", "max",
                        F.posexplode("percentiles").alias("pos", "percentile"))


@query("s11_metrics_store")
def _(s, d):
    path = scratch_path(s, "metrics")
    metrics = cls.threshold_metrics(log_labelled(s, d), "risk_score", "actual_outcome")
    stores.append_metrics(metrics, path, "run1", "test")
    return s.read.parquet(path)


# --- itinerary parse ----------------------------------------------------------------
def _parsed(name: str, *columns: str) -> None:
    @query(name)
    def _(s, d):
        return it.parse_itineraries(V.itineraries(s, d)).select("order_id", *columns)


_parsed("n1_service_category", "service_category")
_parsed("n2_promise_window", "collect_date", "time_range", "time_range_from", "time_range_to")
_parsed("n3_operation_counts", "num_ops", "num_processes", "num_legs")
_parsed("n4_transfers", "num_transfers")
_parsed("n5_logistic_processes", "has_crossdocking", "has_first_mile", "num_logistic_processes")
_parsed("n6_delivery_type", "delivery_type")
_parsed("n7_origin_node", "origin_node_type", "origin_node_name", "origin_operator")
_parsed("n8_destination_node", "dest_node_type", "dest_node_name")
_parsed("n9_operators", "num_operators", "operators_list")
_parsed("n10_final_carrier", "final_carrier")
_parsed("n11_planned_span", "total_span_hours", "start_hour")
_parsed("n12_process_time", "total_process_time_mins")
_parsed("n13_picking_window", "picking_window_hours")


# --- projections ----------------------------------------------------------------------
def _derived(name: str, *columns: str) -> None:
    @query(name)
    def _(s, d):
        return parse_features(s, d).select("order_id", *columns)


_derived("p1_complexity_score", "complexity_score")
_derived("p2_span_ratio", "span_ratio")
_derived("p3_route_flags", "short_picking_window", "complex_route", "anomalous_span", "seller_origin")


@query("p4_iso_dates")
def _(s, d):
    src = V.source_packages(s, d)
    return src.select("package_id", dates.iso_timestamp(F.col("fecha_estado_producto")).alias("parsed"))


@query("p5_mixed_dates")
def _(s, d):
    src = V.source_packages(s, d)
    return src.select("package_id", dates.mixed_timestamp(F.col("fecha_pactada_hasta")).alias("parsed"))


@query("p6_creation_time")
def _(s, d):
    loaded, _ = readers.load_packages(V.source_packages(s, d))
    return loaded.groupBy(F.col("fecha_creacion").isNull().alias("missing")).agg(
        F.count("*").alias("n"), F.count_if(F.col("fecha_creacion") == F.col("fecha_estado_producto")).alias("same"))


@query("p7_target")
def _(s, d):
    return ds.with_target(V.packages(s, d)).select("package_id", C.TARGET)


@query("p8_calendar")
def _(s, d):
    loaded, _ = readers.load_packages(V.source_packages(s, d))
    return ds.with_calendar(loaded).select("package_id", *C.CALENDAR_FEATURES, "es_fin_semana")


@query("p9_query_calendar")
def _(s, d):
    created = dates.iso_timestamp(F.col("fecha_creacion"))
    return V.scoring_queries(s, d).select(
        "package_id", *[v.alias(k) for k, v in dates.calendar(created, None).items()])


for _key, _name in [("p10_hours_since_creation", "tiempo_desde_creacion"), ("p11_hours_to_promise", "tiempo_hasta_eta"),
                    ("p12_promise_used", "porcentaje_eta_consumido"), ("p13_hours_silent", "tiempo_ultimo_evento"),
                    ("p14_flow_speed", "velocidad_flujo"), ("p15_itinerary_deviation", "desviacion_vs_itinerario"),
                    ("p16_last_state_code", "ultimo_estado_codigo")]:
    @query(_key)
    def _(s, d, _name=_name):
        return ordered_events(s, d).select("order_id", _name)


@query("p18_confidence")
def _(s, d):
    return V.prediction_log(s, d).select(
        "package_id", risk.confidence(F.col("risk_score"), F.lit(0.5)).alias("confidence"))


@query("p19_action")
def _(s, d):
    return V.prediction_log(s, d).select("package_id", risk.action(F.col("risk_score")).alias("action"))


@query("p20_outcome")
def _(s, d):
    threshold = (F.when(F.col("dia_semana") == 0, 0.0).when(F.col("dia_semana") == 1, 0.3)
                 .when(F.col("dia_semana") == 2, 0.7))
    judged = scoring.judge(V.prediction_log(s, d).withColumn("risk_score", F.col("risk_score") / 3), threshold)
    return judged.select("package_id", "risk_score", "threshold_used", "predicted_outcome")


@query("p21_disruption_type")
def _(s, d):
    top = stated_factors(s, d, 1)
    first = F.col("contributing_factors")[0]["feature"]
    return top.select("package_id", risk.disruption_type(first).alias("disruption_type"))


@query("p22_factor_text")
def _(s, d):
    f, c = F.col("feature"), F.col("contribution")
    return contributions(s, d).select(
        "package_id", "feature", risk.factor_text(f, c).alias("description"),
        risk.factor_text(f, c, most_specific=True).alias("specific"))


@query("p23_carrier_band")
def _(s, d):
    return rep.carrier_scores(features(s, d), 1).select("final_carrier", "band")


@query("p24_peak_hour")
def _(s, d):
    return features(s, d).where(F.col("start_hour").isNotNull()).select(
        "order_id", risk.peak_hour(F.col("start_hour")).alias("peak"))


@query("p25_high_risk_zone")
def _(s, d):
    return rep.high_risk_zone(features(s, d))


@query("p26_clipped")
def _(s, d):
    return features(s, d).select(
        "order_id", num.cap(F.col("picking_window_hours"), 3).alias("window_capped"),
        num.cap(F.col("span_ratio"), 15).alias("ratio_capped"))


@query("p27_padded_columns")
def _(s, d):
    padded = S.conform(labelled(s, d), S.FEATURE_TYPES)
    return frequency.null_counts(padded, ["carrier", "num_ops", "span_ratio", "es_fin_semana"])


@query("p28_clean_keys")
def _(s, d):
    messy = V.packages(s, d).select(
        "package_id", F.concat(F.lit("  "), F.lower("carrier"), F.lit("   x ")).alias("carrier"))
    return messy.select("package_id", num.clean_key(F.col("carrier")).alias("carrier"))


# --- joins -----------------------------------------------------------------------------
@query("j1_event_join")
def _(s, d):
    joined = joins.join_events(V.order_headers(s, d), event_log.events_per_order(V.event_log(s, d)))
    return joined.select("order_id", "num_eventos", "primer_evento_ts", "ultimo_evento_ts", "ultimo_tipo")


@query("j1_bucketed_join")
def _(s, d):
    """The same from two stored tables in buckets by order: neither side is moved."""
    heads, events = bucketed_orders(s, d)
    return joins.join_events(heads, event_log.events_per_order(events).hint("merge")).select(
        "order_id", "num_eventos", "primer_evento_ts", "ultimo_evento_ts", "ultimo_tipo")


@query("j2_itinerary_join")
def _(s, d):
    joined = joins.join_itineraries(V.packages(s, d), features(s, d), V.order_mapping(s, d))
    return joined.select("package_id", "num_ops", "complexity_score", "span_ratio")


@query("j3_rate_lookup")
def _(s, d):
    return split_live_data(s, d).rows.select("package_id", "split", "tasa_fallo_carrier", "tasa_fallo_region")


@query("j4_pair_rate_lookup")
def _(s, d):
    return split_data(s, d).rows.select("package_id", "tasa_fallo_carrier_region")


@query("j5_scoring_rate_lookup")
def _(s, d):
    rates = split_data(s, d).rates
    flat = V.scoring_queries(s, d).select("package_id", "context.carrier", "context.region")
    return rates.apply(rt.empty_to_null(flat), salt_by="package_id").select("package_id", *C.RATE_FEATURES)


@query("j6_category_median_lookup")
def _(s, d):
    f = features(s, d)
    medians = rep.span_median(f)
    return joins.lookup(f.select("order_id", "service_category", "total_span_hours"),
                        medians, ["service_category"]).select(
        "order_id", (F.col("total_span_hours") / F.nullif("median", F.lit(0.0))).alias("span_ratio_computed"))


@query("j7_scalar_share")
def _(s, d):
    p = labelled(s, d)
    overall = p.agg(F.avg(C.TARGET)).scalar()
    return frequency.late_rate(p, "comuna").select(
        "comuna", "late_rate", (F.col("late_rate") - overall).alias("above_global"))


@query("j8_semi_anti")
def _(s, d):
    heads, events = V.order_headers(s, d), V.event_log(s, d).select("order_id").distinct()
    with_ = joins.known_to(heads, events, ["order_id"]).agg(F.count("*").alias("n"))
    without = joins.unknown_to(heads, events, ["order_id"]).agg(F.count("*").alias("n"))
    return with_.select(F.lit("with_events").alias("kind"), "n").unionByName(
        without.select(F.lit("without_events").alias("kind"), "n"))


# --- aggregates ---------------------------------------------------------------------------
@query("a1_events_per_order")
def _(s, d):
    return event_log.events_per_order(V.event_log(s, d))


@query("a2_global_rate")
def _(s, d):
    return labelled(s, d).agg(F.avg(C.TARGET).alias("late_rate"))


@query("a3_rates_by_key")
def _(s, d):
    train = split_rows(s, d).where(F.col("split") == "train")
    return rt.rate_table(train).where(F.col("level").isin("carrier", "region")).select(
        "level", F.coalesce("carrier", "region").alias("value"), "late", "n", "rate")


@query("a4_rates_by_pair")
def _(s, d):
    train = split_rows(s, d).where(F.col("split") == "train")
    return rt.rate_table(train)


@query("a5_target_balance")
def _(s, d):
    return frequency.target_balance(labelled(s, d))


for _column in ["service_category", "delivery_type", "origin_node_type", "dest_node_type", "num_operators"]:
    @query(f"a6_count_{_column}")
    def _(s, d, _column=_column):
        return frequency.value_counts(features(s, d), [_column])


@query("a6_count_crossdock")
def _(s, d):
    return rep.crossdock_share(features(s, d))


@query("a7_operations_histogram")
def _(s, d):
    return frequency.value_counts(features(s, d), ["num_ops"]).orderBy("num_ops")


@query("a7_start_hours")
def _(s, d):
    return rep.start_hours(features(s, d))


@query("a8_service_by_delivery")
def _(s, d):
    return frequency.value_counts(features(s, d), ["service_category", "delivery_type"])


@query("a9_span_median")
def _(s, d):
    return rep.span_median(features(s, d))


@query("a10_span_percentiles")
def _(s, d):
    return rep.span_percentiles(features(s, d))


SKETCHED = [0.05, 0.25, 0.5, 0.75, 0.95]


@query("a10_sketched_percentiles")
def _(s, d):
    """Percentiles per region from merged day sketches, held against the rows: within twice the stated rank error."""
    log = V.prediction_log(s, d).withColumn("x", F.col("risk_score") + F.col("hora_creacion"))
    stored = staged(s, d, "day_quantiles", lambda s, d: sk.day_quantiles(log, F.to_date("timestamp"), "x", ["region"]))
    found = sk.merged_quantiles(stored, SKETCHED, ["region"])
    return sk.rank_errors(found, log, "x", ["region"]).select(
        "region", "prob", "n", (F.col("rank_error") <= 2 * sk.rank_error()).alias("within"))


@query("a24_sketched_distincts")
def _(s, d):
    """Distinct packages and carriers per month from merged day sketches, held against the exact counts: within
    four standard errors."""
    log = V.prediction_log(s, d)
    columns, month = ["package_id", "carrier"], F.date_format("day", "yyyy-MM")
    stored = staged(s, d, "day_distincts", lambda s, d: sk.day_distincts(log, F.to_date("timestamp"), columns))
    found = sk.merged_distincts(stored.withColumn("month", month), columns, ["month"])
    exact = log.groupBy(F.date_format("timestamp", "yyyy-MM").alias("month")).agg(
        *[F.count_distinct(c).alias(f"{c}_exact") for c in columns])
    near = [(F.abs(F.col(c) - F.col(f"{c}_exact")) <= 4 * sk.distinct_error() * F.col(f"{c}_exact")).alias(f"{c}_within") for c in columns]
    return found.join(exact, "month").select("month", *[f"{c}_exact" for c in columns], *near)


@query("a11_span_boxes")
def _(s, d):
    return histograms.box_stats(features(s, d), "service_category", "total_span_hours", C.BOX_CATEGORIES)


@query("a12_picking_summary")
def _(s, d):
    return rep.picking_summary(features(s, d))


@query("a13_picking_histogram")
def _(s, d):
    return rep.picking_histogram(features(s, d))


@query("a13_span_ratio_histogram")
def _(s, d):
    return rep.span_ratio_histogram(features(s, d))


@query("a14_score_histogram")
def _(s, d):
    return histograms.edge_histogram(features(s, d), "complexity_score", C.SCORE_EDGES)


@query("a15_risk_signals")
def _(s, d):
    return rep.signal_totals(features(s, d))


@query("a16_signals_by_origin")
def _(s, d):
    return rep.signal_rates_by_origin(features(s, d))


@query("a17_carrier_score")
def _(s, d):
    return rep.carrier_scores(features(s, d))


@query("a18_findings")
def _(s, d):
    return rep.findings(features(s, d), ["OP1", "OP2"])


@query("a19_target_shares")
def _(s, d):
    return ex.target_shares(labelled(s, d))


@query("a20_monthly_rate")
def _(s, d):
    return ex.monthly_rate(labelled(s, d))


@query("a21_worst_carriers")
def _(s, d):
    return ex.worst_carriers(labelled(s, d))


CORRELATED = ["dia_semana", "hora_creacion", "mes", "es_fin_semana", "risk_score", "dias_atraso"]


@query("a22_correlations")
def _(s, d):
    return histograms.target_correlations(labelled(s, d), CORRELATED)


@query("a22_strongest_correlations")
def _(s, d):
    return histograms.strongest(histograms.target_correlations(labelled(s, d), CORRELATED), 5)


@query("a23_class_histograms")
def _(s, d):
    return ex.class_histograms(joined(s, d))


@query("a24_events_by_type")
def _(s, d):
    return event_log.profile_by_type(V.event_log(s, d))


@query("a24_event_range")
def _(s, d):
    return event_log.profile_range(V.event_log(s, d))


@query("a24_events_per_order_stats")
def _(s, d):
    return event_log.profile_per_order(V.event_log(s, d))


@query("a25_delivery_overview")
def _(s, d):
    return ex.delivery_overview(V.packages(s, d))


@query("a26_dispatch_shares")
def _(s, d):
    return frequency.value_counts(V.packages(s, d), ["metodo_despacho"])


@query("a26_transport_shares")
def _(s, d):
    return frequency.value_counts(V.packages(s, d), ["tipo_transporte"])


@query("a27_carrier_volume")
def _(s, d):
    return ex.volume_and_rate(V.packages(s, d), "carrier")


@query("a27_region_volume")
def _(s, d):
    return ex.volume_and_rate(V.packages(s, d), "region")


@query("a28_days_late")
def _(s, d):
    return ex.days_late(V.packages(s, d))


@query("a28_median_days_late")
def _(s, d):
    return ex.median_days_late(V.packages(s, d))


@query("a29_packages_per_order")
def _(s, d):
    return frequency.packages_per_order(V.packages(s, d))


@query("a30_null_counts")
def _(s, d):
    return frequency.null_counts(V.packages(s, d), ["order_id", "carrier", "estado_entrega", "dias_atraso"])


@query("a30_weekly_volume")
def _(s, d):
    return ex.weekly_volume(V.packages(s, d))


@query("a30_top_states")
def _(s, d):
    p = V.packages(s, d)
    product = frequency.top_values(p, "estado_producto", 10).select(
        F.lit("producto").alias("kind"), F.col("estado_producto").alias("state"), "n")
    return product.unionByName(frequency.top_values(p, "estado_package", 10).select(
        F.lit("package").alias("kind"), F.col("estado_package").alias("state"), "n"))


@query("a30_top_carriers")
def _(s, d):
    return frequency.top_values(V.packages(s, d), "carrier", 15)


@query("a31_batch_counters")
def _(s, d):
    return scoring.batch_summary(V.prediction_log(s, d))


@query("a32_fold_average")
def _(s, d):
    blocks = ts.assign_block(V.prediction_log(s, d).where(F.col("actual_outcome").isNotNull()),
                             ts.fold_cuts(log_labelled(s, d), "timestamp"), "timestamp")
    folds = cls.threshold_metrics(blocks.where(F.col("block") >= 0), "risk_score", "actual_outcome",
                                  {"default": 0.5}, ["block"])
    return cls.fold_average(folds, ["precision", "recall", "f1"])


@query("a33_split_summary")
def _(s, d):
    return ts.split_summary(split_rows(s, d))


@query("a34_load_range")
def _(s, d):
    return ex.date_range(V.packages(s, d))


@query("a35_monthly_carrier_rate")
def _(s, d):
    return ex.monthly_carrier_rate(labelled(s, d))


# --- windows, order, top ---------------------------------------------------------------------
@query("w1_temporal_split")
def _(s, d):
    return split_live(s, d).select("package_id", "split")


@query("w2_row_order_split")
def _(s, d):
    rows = labelled(s, d).withColumn("no_date", F.lit(None).cast("timestamp_ntz"))
    cuts = ts.find_cuts(rows, "no_date", "package_id", lambda n: [n * 67 // 100, n * 84 // 100])
    return ts.assign_split(rows, cuts, "no_date").select("package_id", "split")


@query("w3_cv_blocks")
def _(s, d):
    train = split_rows(s, d).where(F.col("split") == "train")
    return ts.assign_block(train, ts.fold_cuts(train)).select("package_id", "block")


@query("w4_threshold_curve")
def _(s, d):
    return curve(s, d).select("score", "c", "p", "k", "tp")


@query("w5_top_factors")
def _(s, d):
    top = con.top_factors(contributions(s, d), "package_id")  # from the long form
    return top.select("package_id", F.posexplode("contributing_factors").alias("pos", "f")).select(
        "package_id", "pos", "f.feature")


@query("w6_sliding_trend")
def _(s, d):
    return drift.daily_trend(V.prediction_log(s, d))


@query("w7_event_gaps")
def _(s, d):
    return event_log.event_gaps(V.event_log(s, d), 8.0)


@query("w7_event_sessions")
def _(s, d):
    return event_log.sessions(V.event_log(s, d), 8.0)


@query("w8_reference_sample")
def _(s, d):
    train = split_rows(s, d).where(F.col("split") == "train")
    sample = drift.reference_sample(drift.reference_stats(train, ["hora_creacion", "risk_score"]))
    return sample.groupBy("feature", "value").agg(F.count("*").alias("n"))


@query("t1_top_carriers")
def _(s, d):
    return frequency.top_values(features(s, d), "final_carrier", 8)


@query("t1_top_origin_nodes")
def _(s, d):
    return frequency.top_values(features(s, d), "origin_node_name", 12)


@query("t2_carriers_by_score")
def _(s, d):
    return rep.carrier_scores(features(s, d), 1).select("final_carrier", "mean_score")


@query("t3_riskiest")
def _(s, d):
    return ex.riskiest(V.prediction_log(s, d), "package_id").select("package_id", "risk_score", "actual_outcome")


@query("t4_top_importance")
def _(s, d):
    return con.top_importance(con.global_importance(contributions(s, d)), 10)


# --- set operations ------------------------------------------------------------------------------
@query("u1_new_categories")
def _(s, d):
    rows = split_rows(s, d)
    known = drift.known_categories(rows.where(F.col("split") == "train"))
    return drift.new_categories(rows.where(F.col("split") == "test"), known)


@query("u2_event_coverage")
def _(s, d):
    return event_log.event_coverage(V.order_headers(s, d), V.event_log(s, d))


@query("u3_unknown_event_types")
def _(s, d):
    odd = V.event_log(s, d).withColumn("event_type", F.when(
        F.col("event_id") % 9 == 0, F.concat("event_type", F.lit("_x"))).otherwise(F.col("event_type")))
    return event_log.unknown_types(odd)


@query("u4_concatenate")
def _(s, d):
    rows = split_rows(s, d)
    parts = [rows.where(F.col("split") == name).select("split", C.TARGET) for name in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").agg(
        F.count("*").alias("n"), F.sum(C.TARGET).alias("late"))


# --- preparation and model --------------------------------------------------------------------------
PREPARED = C.CATEGORICAL_FEATURES + C.CALENDAR_FEATURES + C.RATE_FEATURES + ["es_fin_semana"]


@query("m1_scaled_numbers")
def _(s, d):
    rows = joined_split(s, d)
    columns = ["mes", "num_ops", "picking_window_hours", "span_ratio"]
    stats = {r["feature"]: (r["median"], r["mean"], r["std"]) for r in prep.numeric_stats(
        rows.where(F.col("split") == "train"), columns).collect()}
    return rows.select("package_id", *[prep.scaled(F.col(c), *stats[c]).alias(c) for c in columns])


@query("m2_category_levels")
def _(s, d):
    train = split_rows(s, d).where(F.col("split") == "train")
    return prep.category_levels(train, C.CATEGORICAL_FEATURES)


@query("m2_encoded_rows")
def _(s, d):
    rows = split_rows(s, d)
    levels = prep.category_levels(rows.where(F.col("split") == "train"), C.CATEGORICAL_FEATURES)
    test = order_stats.long_form(rows.where(F.col("split") == "test"), C.CATEGORICAL_FEATURES,
                                 kind="string").withColumn("value", F.coalesce("value", F.lit(C.UNKNOWN)))
    placed = joins.lookup(test, levels.drop("n"), ["feature", "value"])
    return placed.groupBy("feature", "level").agg(F.count("*").alias("n"))


@query("m3_boolean_fill")
def _(s, d):
    return joined(s, d).select("package_id", *[
        F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in ("has_crossdocking", "complex_route")])


_FITTED: dict[tuple, tuple] = {}


def fitted(s: SparkSession, d: str) -> tuple[ds.SplitData, training.RiskModel, dict]:
    """The trained model of a data folder; a model is an artefact, so it is trained once
    per session and used by the queries that score."""
    key = (s.sparkContext.applicationId, d)
    if key not in _FITTED:
        data = split_data(s, d)
        model = training.train_model(data, PREPARED, version="v1")
        typical = con.typical_values(data.part("train"), model.preparer)
        _FITTED[key] = data, model, typical
    return _FITTED[key]


_PREPARED: dict[tuple, tuple] = {}


def preparation(s: SparkSession, d: str) -> tuple[ds.SplitData, prep.Preparer]:
    """The learnt preparation of a data folder, an artefact of its own."""
    key = (s.sparkContext.applicationId, d)
    if key not in _PREPARED:
        data = split_data(s, d)
        _PREPARED[key] = data, prep.fit_preparer(data.part("train"), PREPARED)
    return _PREPARED[key]


@query("m4_feature_vector")
def _(s, d):
    """The one-hot vector of every row, entry by entry, without the zeros."""
    data, fitted_ = preparation(s, d)
    return (fitted_.transform(data.rows, encoding="one_hot", salt_by="package_id")
            .select("package_id", F.explode(prep.vector_entries("features")).alias("_e"))
            .select("package_id", "_e.slot", "_e.value").where("value <> 0"))


@query("m4_rate_vector")
def _(s, d):
    """The vector the trees read: one entry per raw feature."""
    from pyspark.ml.functions import vector_to_array
    data, fitted_ = preparation(s, d)
    array = vector_to_array("features")
    return fitted_.transform(data.rows, salt_by="package_id").select(
        "package_id", *[F.get(array, F.lit(i)).alias(name) for i, name in enumerate(fitted_.raw_features)])


@query("m5_prepared_splits")
def _(s, d):
    data, fitted_ = preparation(s, d)
    return fitted_.transform(data.rows, encoding="one_hot", salt_by="package_id").groupBy("split").agg(
        F.count("*").alias("n"), F.max(prep.vector_width("features")).alias("width"))


@query("p17_slot_names")
def _(s, d):
    return preparation(s, d)[1].slot_names()


@query("m6_class_weight")
def _(s, d):
    train = split_rows(s, d).where(F.col("split") == "train")
    return train.sparkSession.createDataFrame([(training.class_weight(train),)], "class_weight double")


@query("m7_trained_scores")
def _(s, d):
    data, model, _ = fitted(s, d)
    return model.predict(data.rows).select("package_id", "split", "risk_score")


def cross_validated(s: SparkSession, d: str) -> DataFrame:
    return training.cross_validate(split_data(s, d).part("train"), PREPARED)


@query("m8_cross_validation")
def _(s, d):
    """Fold metrics: five trained models, made once per session."""
    return staged(s, d, "folds", cross_validated)


@query("m9_calibration")
def _(s, d):
    return cls.calibrate(curve(s, d))


@query("m10_targets_met")
def _(s, d):
    at_ = cls.threshold_metrics(log_labelled(s, d), "risk_score", "actual_outcome")
    area = cls.area_metrics(curve(s, d))
    return cls.targets_met(at_.select("name", "precision", "recall", area.select("pr_auc").scalar().alias("pr_auc")))


# --- evaluation -----------------------------------------------------------------------------------
@query("e1_threshold_metrics")
def _(s, d):
    return cls.threshold_metrics(log_labelled(s, d), "risk_score", "actual_outcome")


@query("e2_pr_auc")
def _(s, d):
    return cls.area_metrics(curve(s, d)).select("pr_auc", "n", "positives")


@query("e2_binned_areas")
def _(s, d):
    """Areas per year from stored day bins: the exact areas lie within the bounds."""
    log, year = log_labelled(s, d), F.year("day").alias("year")
    stored = staged(s, d, "day_bins", lambda s, d: sk.day_score_bins(log, F.to_date("timestamp"), "risk_score", "actual_outcome", 250))
    found = sk.binned_areas(stored.withColumn("year", year), ["year"])
    exact = cls.area_metrics(cls.score_curve(log.withColumn("year", F.year("timestamp")), "risk_score", "actual_outcome", ["year"]), ["year"])
    return found.join(exact.drop("n", "positives"), "year").select("year", "n", "positives", *[
        F.col(a).between(F.col(f"{a}_low") - 1e-9, F.col(f"{a}_high") + 1e-9).alias(f"{a}_within") for a in ("pr_auc", "roc_auc")])


@query("e3_roc_auc")
def _(s, d):
    return cls.area_metrics(curve(s, d)).select("roc_auc")


@query("e4_curve_points")
def _(s, d):
    return cls.curve_points(curve(s, d))


@query("e5_threshold_accepted")
def _(s, d):
    return cls.accepted(cls.threshold_metrics(log_labelled(s, d), "risk_score", "actual_outcome")).select(
        "name", "accepted")


# --- drift ------------------------------------------------------------------------------------------
DRIFT_FEATURES = ["dia_semana", "hora_creacion", "mes", "tasa_fallo_carrier"]


def _drift_inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    data = split_data(s, d)
    log = data.rates.apply(V.prediction_log(s, d), salt_by="package_id")
    return data.part("train"), log, drift.recent_rows(log, at(LOG_AS_OF), LOG_DAYS)


@query("d1_performance_drift")
def _(s, d):
    recent = drift.recent_rows(V.prediction_log(s, d), at(LOG_AS_OF), LOG_DAYS)
    return drift.performance_check(recent)


@query("d2_feature_drift")
def _(s, d):
    train, _, recent = _drift_inputs(s, d)
    stats = drift.reference_stats(train, DRIFT_FEATURES)
    return drift.feature_drift(recent, stats, DRIFT_FEATURES).drop("p_value")


@query("d2_drift_p_values")
def _(s, d):
    train, _, recent = _drift_inputs(s, d)
    return drift.feature_drift(recent, drift.reference_stats(train, DRIFT_FEATURES), DRIFT_FEATURES).select("feature", "p_value")


@query("d3_raw_feature_stats")
def _(s, d):
    train = joined_split(s, d).where(F.col("split") == "train")
    stats = drift.reference_stats(train, ["num_ops", "num_transfers", "total_span_hours", "complexity_score"])
    return stats.select("feature", "n", "mean", "std", "min", "max",
                        F.posexplode("percentiles").alias("pos", "percentile"))


@query("d4_unseen_in_log")
def _(s, d):
    train, _, recent = _drift_inputs(s, d)
    return drift.new_categories(recent, drift.known_categories(train)).groupBy("column").agg(F.count("*").alias("n"))


@query("d5_retrain_decision")
def _(s, d):
    train, log, _ = _drift_inputs(s, d)
    reference = monitoring.learn_reference(train, DRIFT_FEATURES)
    report = monitoring.monitor(log, reference, DRIFT_FEATURES, at(LOG_AS_OF), days=LOG_DAYS)
    return report.drop("checked_at").withColumn("reasons", F.array_join("reasons", "; "))


@query("s13_monitor_report")
def _(s, d):
    train, log, _ = _drift_inputs(s, d)
    reference = monitoring.learn_reference(train, DRIFT_FEATURES)
    path = scratch_path(s, "monitor")
    stores.store_run(monitoring.monitor(log, reference, DRIFT_FEATURES, at(LOG_AS_OF), days=LOG_DAYS), path, LOG_AS_OF, "monitor")
    return s.read.parquet(path).drop("run", "part").withColumn("reasons", F.array_join("reasons", "; "))


# --- scoring -------------------------------------------------------------------------------------------
@query("x1_query_features")
def _(s, d):
    rates = split_data(s, d).rates
    return scoring.query_features(V.scoring_queries(s, d), rates).select(
        "package_id", "carrier", "region", *C.CALENDAR_FEATURES, "es_fin_semana", "num_ops", *C.RATE_FEATURES)


@query("x2_batch_scoring")
def _(s, d):
    """Predictions with their factors; the factors as text, so that rows can be compared."""
    _, model, typical = fitted(s, d)
    broken = F.col("package_id").endswith("7")
    queries = V.scoring_queries(s, d).withColumn("order_id", F.when(~broken, F.col("order_id")))
    return scoring.score_queries(queries, model, at(LOG_AS_OF), typical=typical).withColumn(
        "contributing_factors", F.to_json("contributing_factors"))


@query("x2_stated_scoring")
def _(s, d):
    """Batch scoring with the stated model: scores, outcomes, factors, and rows that cannot be scored."""
    broken = F.col("package_id").endswith("7")
    queries = V.scoring_queries(s, d).withColumn("order_id", F.when(~broken, F.col("order_id")))
    made = scoring.score_queries(queries, StatedModel(split_data(s, d).rates), at(LOG_AS_OF), typical=dict.fromkeys(STATED_FEATURES, 0.0))
    return made.withColumn("contributing_factors", F.array_join(F.transform("contributing_factors", lambda f: f["feature"]), ","))


@query("x3_global_importance")
def _(s, d):
    return con.global_importance(contributions(s, d))


@query("x4_factor_texts")
def _(s, d):
    top = stated_factors(s, d)
    return top.select("package_id", F.posexplode("contributing_factors").alias("pos", "f")).select(
        "package_id", "pos", "f.*")


def model_contributions(s: SparkSession, d: str) -> DataFrame:
    """Contributions of the trained model for all rows of the split, stored once."""
    def build(s: SparkSession, d: str) -> DataFrame:
        data, model, typical = fitted(s, d)
        prepared = model.preparer.transform(data.rows, salt_by="package_id")
        return model.contributions(prepared, "package_id", typical)
    return staged(s, d, "contributions", build)


@query("x5_tree_contributions")
def _(s, d):
    return contributions(s, d)


@query("x5_tree_margins")
def _(s, d):
    return stated_contributions(s, d).select("package_id", "margin")


@query("x5_occlusion")
def _(s, d):
    return model_contributions(s, d)


@query("x3_model_importance")
def _(s, d):
    return con.global_importance(model_contributions(s, d))


@query("x4_model_factors")
def _(s, d):
    data, model, typical = fitted(s, d)
    rows = model.explained(model.preparer.transform(data.rows, salt_by="package_id").select("package_id", "features"), typical)
    factors = con.row_factors(F.col("contributions"), model.preparer.raw_features)
    return rows.select("package_id", F.posexplode(factors).alias("pos", "f")).select("package_id", "pos", "f.*")


@query("t4_model_top_importance")
def _(s, d):
    return con.top_importance(con.global_importance(model_contributions(s, d)), 10)


@query("s12_model_registry")
def _(s, d):
    _, model, _ = fitted(s, d)
    registry = stores.ModelRegistry(s, scratch_path(s, "models"))
    registry.save(model, date(2001, 8, 1))
    registry.save(model, date(2001, 8, 2))
    scored = registry.load().predict(split_data(s, d).rows)
    return registry.versions().select("number", "version", "features", "saved_on",
                                      scored.agg(F.count("*")).scalar().alias("scored"))


# --- joined runs -----------------------------------------------------------------------------------------
_RUNS: dict[tuple, tuple] = {}


def trained_run(s: SparkSession, d: str, with_folds: bool = False) -> tuple[ds.SplitData, training.RiskModel, DataFrame, str, str]:
    """One training run per session: its model, validation row, metrics table and reference. What
    reads no fold metrics takes a run without them."""
    key = next((k for k in _RUNS if k[:2] == (s.sparkContext.applicationId, d) and k[2] >= with_folds), None)
    if key is None:
        key = (s.sparkContext.applicationId, d, with_folds)
        data, metrics = split_data(s, d), scratch_path(s, "metrics")
        registry = stores.ModelRegistry(s, scratch_path(s, "run-models"))
        reference = scratch_path(s, "reference")
        model, report = runs.train_run(data, PREPARED, registry, metrics, reference, date(2001, 8, 1), DRIFT_FEATURES,
                                       folds=staged(s, d, "folds", cross_validated) if staged_before(s, d, "folds") else None,
                                       cross_validation=with_folds)
        _RUNS[key] = data, model, report, metrics, reference
    return _RUNS[key]


@query("r1_training_run")
def _(s, d):
    """What a training run stores: metrics, sizes and parameters by part."""
    _, _, _, metrics, _ = trained_run(s, d, with_folds=True)
    return s.read.parquet(metrics).where(F.col("part").isin("validation", "folds")).select("run", "part", "metric", "value")


@query("r1_run_sizes")
def _(s, d):
    """The deterministic part of it, for which no model is trained."""
    data, fitted_ = preparation(s, d)
    sizes = runs.run_sizes(data, fitted_).withColumn("version", F.lit(stores.version_name(1, date(2001, 8, 1))))
    return sizes.select("version", "train_rows", "val_rows", "test_rows", "class_weight", "features",
                         *[f"param_{k}" for k in C.BOOSTER])


@query("r2_evaluation_run")
def _(s, d):
    data, model, _, metrics, _ = trained_run(s, d)
    runs.evaluation_run(data, model, metrics)
    return s.read.parquet(metrics).where(F.col("part").isin("test", "accepted", "importance")).select("run", "part", "threshold_name", "metric", "value")


@query("r3_monitoring_run")
def _(s, d):
    """Scored orders, their log, the outcomes known by now, and the check against the stored metrics."""
    data, model, _, metrics, reference = trained_run(s, d)
    outcomes = data.rows.select("package_id", F.col(C.TARGET).alias("outcome"))
    report = runs.monitoring_run(V.scoring_queries(s, d), outcomes, model, metrics, reference,
                                 scratch_path(s, "prediction-log"), at(LOG_AS_OF), "2001-08-01", DRIFT_FEATURES)
    return report.select("n_labelled", "category_trigger", "new_values")


# --- streams -----------------------------------------------------------------------------------------------
@query("st1_event_stream")
def _(s, d):
    raw = jobs.file_stream(s, d, V.table(s, d, "events").schema, pattern="events.parquet")
    table = scratch_path(s, "event-state")
    jobs.run_event_state(V.map_events(raw), table, scratch_path(s, "chk")).awaitTermination()
    return jobs.event_state(s, table)


@query("st2_prediction_stream")
def _(s, d):
    lines = jobs.file_stream(s, d, V.table(s, d, "lineitem").schema, pattern="lineitem.parquet")
    table = scratch_path(s, "trend")
    jobs.run_day_totals(V.prediction_log(s, d, lines), table, scratch_path(s, "chk")).awaitTermination()
    return jobs.sliding_state(s, table)


@query("st3_scoring_stream")
def _(s, d):
    _, model, typical = fitted(s, d)
    folder = scratch_path(s, "queries")
    V.scoring_queries(s, d).write.json(folder)
    table = scratch_path(s, "scored")
    jobs.run_scoring(s, folder, table, scratch_path(s, "chk"), model, LOG_AS_OF, typical).awaitTermination()
    return s.read.parquet(table).drop("batch").withColumn("contributing_factors", F.to_json("contributing_factors"))


def landed_twice(s: SparkSession, d: str) -> DataFrame:
    """A stream of event files, a fifth of the events once more in files of their own."""
    events, folder = V.table(s, d, "events"), scratch_path(s, "landed")
    events.write.parquet(folder)
    events.where(F.col("event_id") % 5 == 0).write.mode("append").parquet(folder)
    return V.map_events(jobs.file_stream(s, folder, events.schema))


@query("st1_live_orders")
def _(s, d):
    """Orders kept as state in update mode, repeated events counted once."""
    table = scratch_path(s, "live")
    state.run_live_orders(landed_twice(s, d), table, scratch_path(s, "chk"), late_by="60 days", silent_days=90).awaitTermination()
    return state.order_states(s, table)


@query("st4_session_stream")
def _(s, d):
    """Sessions that have closed by the end of the stream."""
    table = scratch_path(s, "sessions")
    state.run_sessions(landed_twice(s, d), table, scratch_path(s, "chk"), 8.0, late_by="2 days").awaitTermination()
    return s.read.parquet(table)


@query("st5_outcome_stream")
def _(s, d):
    """Predictions completed by the outcomes that arrive within 20 days of them."""
    made, known, table = (scratch_path(s, n) for n in ("made", "known", "completed"))
    store(V.prediction_log(s, d).withColumn("actual_outcome", F.lit(None).cast("int")), made)
    store(V.outcomes(s, d), known)
    log, outcomes = s.read.parquet(made), s.read.parquet(known)
    state.run_completions(jobs.file_stream(s, made, log.schema), jobs.file_stream(s, known, outcomes.schema), table,
                          scratch_path(s, "chk"), within="20 days").awaitTermination()
    return state.completed_log(log, s.read.parquet(table)).select("package_id", "timestamp", "actual_outcome")
