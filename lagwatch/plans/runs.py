"""The joined runs: train and store, evaluate and store, score, log and monitor."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.classification import accepted
from ..operators.contributions import global_importance, typical_values
from ..operators.preparation import Preparer
from ..session import concurrently, written
from ..sources.stores import ModelRegistry, append_metrics, store_run, stored_metric
from . import monitoring, scoring, training
from .dataset import SplitData


def run_sizes(data: SplitData, preparer: Preparer, params: dict | None = None) -> DataFrame:
    """One row of what a training run states besides its metrics: rows of each split, class weight,
    entries of the one-hot vector, parameters. No model is needed for it."""
    late, split = F.col(C.TARGET), F.col("split")
    n, positives = F.count(F.when(split == "train", late)), F.coalesce(F.sum(F.when(split == "train", late)), F.lit(0))
    return data.rows.agg(
        *[F.count_if(split == s).alias(f"{s}_rows") for s in ("train", "val", "test")],
        ((n - positives) / F.greatest(positives, F.lit(1))).alias("class_weight"),
    ).withColumns({"features": F.lit(preparer.width), **{f"param_{k}": F.lit(float(v)) for k, v in {**C.BOOSTER, **(params or {})}.items()}})


def train_run(data: SplitData, features: Sequence[str], registry: ModelRegistry, metrics: str, reference: str, on: date,
              watched: Sequence[str], params: dict | None = None, folds: DataFrame | None = None,
              cross_validation: bool = True) -> tuple[training.RiskModel, DataFrame]:
    """Folds, fit, validation and calibration; model and metrics are stored under the version, and
    what later checks compare with, for the ``watched`` features, in the ``reference`` folder. The folds, the
    model and the reference run side by side.

    Returns the model and its validation row. ``folds`` takes fold metrics made before; without
    ``cross_validation`` and without those, none are made or stored.
    """
    train = data.part("train")
    folds, model, known = concurrently(data.rows.sparkSession, [
        lambda: written(training.cross_validate(train, features, params=params), "folds") if folds is None and cross_validation else folds,
        lambda: training.train_model(data, features, params),
        lambda: monitoring.learn_reference(train, watched)])
    version = registry.save(model, on)
    model = registry.load(version)
    report = written(training.validation_report(model.predict(data.part("val"))).crossJoin(
        F.broadcast(run_sizes(data, model.preparer, params))), "validation")
    append_metrics(report, metrics, version, "validation")
    if folds is not None:
        append_metrics(training.cv_summary(folds), metrics, version, "folds")
    known.save(reference)
    return model, report.withColumn("version", F.lit(version))


def evaluation_run(data: SplitData, model: training.RiskModel, metrics: str) -> DataFrame:
    """Test metrics at the three thresholds with acceptance, and the importance of each feature, stored
    under the model's version. Returns the metric rows."""
    test = written(data.part("test"), "test")
    rows = written(training.evaluate(model.predict(test)), "evaluation")
    append_metrics(rows, metrics, model.version, "test")
    append_metrics(accepted(rows), metrics, model.version, "accepted")
    typical = typical_values(data.part("train"), model.preparer)
    parts = model.contributions(model.preparer.transform(test), "package_id", typical)
    store_run(global_importance(parts).select(F.lit(None).cast("string").alias("threshold_name"),
                                              F.concat(F.lit("importance."), "feature").alias("metric"), F.col("mean_abs").alias("value")),
              metrics, model.version, "importance")
    return rows


def monitoring_run(queries: DataFrame, outcomes: DataFrame, model: training.RiskModel, metrics: str, reference: str,
                   log: str, as_of: Column, run: str, watched: Sequence[str], days: int = C.WINDOW_DAYS) -> DataFrame:
    """Score a batch, write its log, complete it with the outcomes known by now, and check it
    against the stored metrics of the model's training. Returns the report row."""
    spark = queries.sparkSession
    made = scoring.prediction_log(scoring.query_features(queries, model.rates), model, as_of)
    store_run(made, log, run, "scored")
    logged = spark.read.parquet(log).where(F.col("part") == "scored").drop("run", "part")
    complete = scoring.fill_outcomes(logged, outcomes)
    baseline = stored_metric(spark, metrics, "validation", "pr_auc")
    known = monitoring.load_reference(spark, reference)
    return monitoring.monitor(complete, known, watched, as_of, C.MIN_PR_AUC if baseline is None else baseline, days)
