"""Fit, cross-validate and calibrate the risk model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, partial, reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.classification import (area_metrics, calibrate, fold_average, score_curve,
                                        targets_met, threshold_metrics)
from ..operators.contributions import long_contributions, margin_of
from ..operators.forest import Forest, with_contributions
from ..operators.preparation import Preparer, fit_preparer, load_preparer
from ..operators.rates import Rates, load_rates
from ..operators.temporal_split import assign_block, fold_cuts
from ..session import concurrently, scratch_path, written
from .dataset import SplitData

METRICS = ["pr_auc", "roc_auc", "precision", "recall", "f1"]


def class_weight(train: DataFrame) -> float:
    """Negatives per positive."""
    row = train.agg(F.count(C.TARGET).alias("n"), F.sum(C.TARGET).alias("late")).first()
    return weight_of(row["n"], row["late"] or 0)


def weight_of(rows: int, late: int) -> float:
    return (rows - late) / max(late, 1)


def booster(params: dict | None = None) -> GBTClassifier:
    """Spark's boosted trees in the role of the booster: same size and rates, but a
    first-order loss and columns drawn per node, so scores differ from other boosters."""
    p = {**C.BOOSTER, **(params or {})}
    return GBTClassifier(
        featuresCol="features", labelCol=C.TARGET, weightCol="weight", maxIter=p["trees"],
        maxDepth=p["depth"], stepSize=p["step"], subsamplingRate=p["rows"],
        featureSubsetStrategy=str(p["columns"]), seed=p["seed"])


#: Bytes of prepared rows in a partition of the training set. A tree level is one short job, so
#: small sets are read in few tasks.
TRAIN_BYTES = 16 << 20


def fit_booster(preparer: Preparer, train: DataFrame, params: dict | None = None) -> GBTClassificationModel:
    """Fit on prepared training rows, positives weighted by the class weight."""
    prepared = written(preparer.transform(train).select("features", F.col(C.TARGET).cast("double").alias(C.TARGET)), "train")
    # every tree reads the rows again: they are prepared once, and counted for the weight and the partitions
    rows = prepared.agg(F.count("*").alias("all"), F.count(C.TARGET).alias("n"), F.sum(C.TARGET).alias("late")).first()
    weight = weight_of(rows["n"], int(rows["late"] or 0))
    parts = 1 + rows["all"] * 8 * (len(preparer.raw_features) + 2) // TRAIN_BYTES
    weighted = prepared.withColumn("weight", F.when(F.col(C.TARGET) == 1, F.lit(float(weight))).otherwise(1.0))
    return booster(params).fit(weighted.coalesce(parts))


def with_scores(model: GBTClassificationModel, prepared: DataFrame) -> DataFrame:
    """Add ``risk_score`` and ``margin``."""
    kept = [c for c in prepared.columns if c not in ("risk_score", "margin")]
    return model.transform(prepared).select(
        *kept, vector_to_array("probability")[1].alias("risk_score"), margin_of().alias("margin"))


@dataclass(frozen=True)
class RiskModel:
    """Everything needed to score a raw row."""

    booster: GBTClassificationModel
    preparer: Preparer
    rates: Rates
    version: str = "unknown"

    def predict(self, rows: DataFrame) -> DataFrame:
        """Raw feature rows to rows with ``risk_score`` and ``margin``."""
        return self.score(self.preparer.transform(rows)).drop("features")

    def score(self, prepared: DataFrame) -> DataFrame:
        """The same for rows that are prepared already; ``features`` stays."""
        return with_scores(self.booster, prepared)

    @cached_property
    def forest(self) -> Forest:
        return Forest.of_model(self.preparer.levels.sparkSession, self.booster)

    def encoded_typical(self, typical: dict[str, object]) -> list[float]:
        """The typical values, encoded like any other row."""
        names = self.preparer.raw_features
        types = {c: "double" for c in self.preparer.numeric} | {c: "string" for c in self.preparer.slots} | {c: "int" for c in self.preparer.boolean}
        row = self.preparer.levels.sparkSession.createDataFrame(
            [tuple(None if typical[n] is None else float(typical[n]) if types[n] == "double" else typical[n] for n in names)],
            ", ".join(f"{n} {types[n]}" for n in names))
        return self.preparer.transform(row).first()["features"].toArray().tolist()

    def explained(self, prepared: DataFrame, typical: dict[str, object]) -> DataFrame:
        """Prepared rows with ``contributions``, an array with one entry per raw feature, in place of
        ``features``. Rows stay where they are."""
        kept = [c for c in prepared.columns if c not in ("features", "_x", "contributions")]
        rows = prepared.select(*kept, vector_to_array("features").alias("_x"))
        return with_contributions(rows, self.forest, self.encoded_typical(typical)).drop("_x")

    def contributions(self, prepared: DataFrame, key: str, typical: dict[str, object]) -> DataFrame:
        """Occlusion contributions of prepared rows, one row per raw feature."""
        rows = self.explained(prepared.select(key, "features"), typical)
        return long_contributions(rows, key, self.preparer.raw_features)

    def save(self, path: str) -> None:
        self.booster.write().save(f"{path}/booster")
        self.preparer.save(f"{path}/preparer")
        self.rates.save(f"{path}/rates")


def load_model(spark: SparkSession, path: str, version: str = "unknown") -> RiskModel:
    return RiskModel(GBTClassificationModel.load(f"{path}/booster"),
                     load_preparer(spark, f"{path}/preparer"), load_rates(spark, f"{path}/rates"), version)


def evaluate(scored: DataFrame) -> DataFrame:
    """Metrics at the three thresholds next to the two areas: three rows."""
    scored = written(scored.select("risk_score", C.TARGET), "scored")  # the model runs once
    areas = area_metrics(score_curve(scored, "risk_score", C.TARGET))
    at = threshold_metrics(scored, "risk_score", C.TARGET)
    return at.select("*", areas.select("pr_auc").scalar().alias("pr_auc"),
                     areas.select("roc_auc").scalar().alias("roc_auc"))


def validation_report(scored: DataFrame) -> DataFrame:
    """One row: metrics at the active threshold, calibrated thresholds, targets."""
    scored = written(scored.select("risk_score", C.TARGET), "scored")
    curve = score_curve(scored, "risk_score", C.TARGET)
    best = calibrate(curve)
    at = threshold_metrics(scored, "risk_score", C.TARGET, {"default": C.ACTIVE_THRESHOLD})
    areas = area_metrics(curve)
    row = at.select(
        areas.select("pr_auc").scalar().alias("pr_auc"), areas.select("roc_auc").scalar().alias("roc_auc"),
        "precision", "recall", "f1", F.col("threshold").alias("threshold_used"),
        *[best.select(name).scalar().alias(name) for name in best.columns])
    return targets_met(row)


def cross_validate(train: DataFrame, features: Sequence[str], ts: str = "fecha_creacion",
                   key: str = "package_id", params: dict | None = None,
                   preparer: Preparer | None = None) -> DataFrame:
    """Expanding time-series folds: one row of metrics per fold.

    Each fold learns its preparation on its own past. Passing a fitted
    ``preparer`` reuses it for all folds, which lets later rows shape earlier folds;
    rate features in ``train`` were learnt on all of it and do the same.
    """
    # every fold reads its past: stored once, a fold reads only the blocks it needs
    path = scratch_path(train.sparkSession, "blocks")
    assign_block(train, fold_cuts(train, ts, key), ts, key).write.partitionBy("block").parquet(path)
    blocks = train.sparkSession.read.parquet(path)

    def scored_fold(fold: int) -> DataFrame:
        past = blocks.where(F.col("block") < fold)
        prep = preparer or fit_preparer(past, features)
        model = fit_booster(prep, past, params)
        tested = with_scores(model, prep.transform(blocks.where(F.col("block") == fold)))
        return written(tested.select(F.lit(fold).alias("fold"), "risk_score", C.TARGET), "fold-scores")

    # a fold is a chain of short jobs: the folds run side by side
    parts = concurrently(train.sparkSession, [partial(scored_fold, fold) for fold in range(C.CV_FOLDS)])
    scored = reduce(DataFrame.unionByName, parts)  # stored: read by the curve and by the thresholds
    areas = area_metrics(score_curve(scored, "risk_score", C.TARGET, ["fold"]), ["fold"])
    at = threshold_metrics(scored, "risk_score", C.TARGET, {"default": C.ACTIVE_THRESHOLD}, ["fold"])
    return areas.alias("a").join(at.alias("t"), F.col("a.fold") == F.col("t.fold")).select(
        "a.fold", "a.n", "a.pr_auc", "a.roc_auc", "t.precision", "t.recall", "t.f1")


def cv_summary(folds: DataFrame) -> DataFrame:
    return fold_average(folds, METRICS)


def train_model(data: SplitData, features: Sequence[str], params: dict | None = None,
                version: str = "unknown") -> RiskModel:
    """Prepare on train and fit the final model. Call with the rate features listed."""
    train = data.part("train")
    preparer = fit_preparer(train, features)
    model = fit_booster(preparer, train, params)
    return RiskModel(model, preparer, data.rates, version)
