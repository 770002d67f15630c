"""The labelled model dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.dates import calendar
from ..operators.event_log import events_per_order, recency_features
from ..operators.joins import join_events, join_itineraries
from ..operators.rates import Rates, fit_rates
from ..operators.temporal_split import Cuts, assign_split, only_split, split_cuts
from ..schemas import model_features


def with_target(packages: DataFrame) -> DataFrame:
    """Label late rows 1 and on-time rows 0; rows in any other state are dropped."""
    state = F.col("estado_entrega")
    label = F.when(state.isin(C.LATE_STATES), 1).when(state.isin(C.ON_TIME_STATES), 0)
    return packages.where(state.isin(C.LATE_STATES + C.ON_TIME_STATES)).withColumn(C.TARGET, label)


def with_calendar(df: DataFrame, ts: str = "fecha_creacion") -> DataFrame:
    return df.withColumns(calendar(F.col(ts)))


def with_events(packages: DataFrame, events: DataFrame | None, as_of: Column) -> DataFrame:
    """Add event-log features; without an event log the rows pass unchanged."""
    if events is None:
        return packages
    return join_events(packages, events_per_order(events)).withColumns(recency_features(as_of))


def build_dataset(packages: DataFrame, itineraries: DataFrame | None = None,
                  mapping: DataFrame | None = None, events: DataFrame | None = None,
                  as_of: Column | None = None) -> tuple[DataFrame, list[str]]:
    """Labelled packages with calendar features, and where the inputs are given with
    itinerary and event features; also the list of model features present."""
    df = with_calendar(with_target(packages))
    if itineraries is not None and mapping is not None:
        df = join_itineraries(df, itineraries, mapping)
    df = with_events(df, events, as_of if as_of is not None else F.lit(None).cast("timestamp_ntz"))
    return df, model_features(df.columns)


@dataclass(frozen=True)
class SplitData:
    """The dataset labelled by split, with rates learnt on its training part."""

    rows: DataFrame
    cuts: Cuts
    rates: Rates
    ts: str = "fecha_creacion"

    def part(self, name: str) -> DataFrame:
        return only_split(self.rows, self.cuts, name, self.ts)


def split_with_rates(dataset: DataFrame, ts: str = "fecha_creacion", key: str = "package_id",
                     leave_one_out: bool = False, min_count: int = 0) -> SplitData:
    """Split by time, learn the late rates on train, and add them to every row."""
    cuts = split_cuts(dataset, ts, key)
    labelled = assign_split(dataset, cuts, ts, key)
    rates = fit_rates(only_split(labelled, cuts, "train", ts), min_count)
    rows = rates.apply(labelled, salt_by=key)
    if leave_one_out:
        train = rates.apply(labelled.where(F.col("split") == "train"), target=C.TARGET, salt_by=key)
        rows = train.unionByName(rows.where(F.col("split") != "train"))
    return SplitData(rows, cuts, rates, ts)
