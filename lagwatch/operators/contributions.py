"""Per-row factor contributions and what is read from them.

Contributions are occlusion differences, not Shapley values: the change of the
model margin when one raw feature is set to its typical training value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import risk
from .preparation import Preparer


def typical_values(train: DataFrame, preparer: Preparer) -> dict[str, object]:
    """Median of numeric features, most frequent value of the others; a missing category is not
    typical. The categories were counted when the preparation was learnt."""
    values: dict[str, object] = {c: stats[0] for c, stats in preparer.numeric.items()}
    levels = preparer.levels.where(F.col("value") != C.UNKNOWN)
    # of equally frequent values the first by name
    tops = {r["feature"]: r["top"] for r in levels.groupBy("feature").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("top")).collect()}
    values |= {c: tops.get(c) for c in preparer.slots}
    if preparer.boolean:
        counts = train.agg(*[F.count_if(F.col(c).cast("int") == v).alias(f"{c}.{v}") for c in preparer.boolean for v in (0, 1)]).first()
        values |= {c: int(counts[f"{c}.1"] > counts[f"{c}.0"]) for c in preparer.boolean}
    return values


def occlusion(prepared: DataFrame, score, key: str, names: Sequence[str], typical: Sequence[float]) -> DataFrame:
    """Long form ``key, feature, contribution``.

    For any scorer; a model of trees has a shorter way (``forest.with_contributions``). ``prepared``
    rows carry the encoded ``features``, one entry per name, and ``score`` adds a ``margin`` to such rows. A row is encoded once; each variant swaps one entry for its typical
    value, in place, so there is neither a shuffle nor a lookup on the repeated rows.
    """
    scored = score(prepared.select(key, "features", vector_to_array("features").alias("_x"))).withColumnRenamed("margin", "_margin")
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("feature"), F.lit(float(v)).alias("v"))
                       for i, (n, v) in enumerate(zip(names, typical, strict=True))])
    variants = scored.select(key, "_margin", "_x", F.explode(wanted).alias("_s"))
    swapped = variants.withColumn("features", array_to_vector(F.transform(
        "_x", lambda x, i: F.when(i == F.col("_s.i"), F.col("_s.v")).otherwise(x))))
    return score(swapped).select(key, F.col("_s.feature").alias("feature"), (F.col("_margin") - F.col("margin")).alias("contribution"))


def long_contributions(rows: DataFrame, key: str, names: Sequence[str], contributions: str = "contributions") -> DataFrame:
    """An array of contributions per row in the long form ``key, feature, contribution``."""
    entry = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col(contributions).alias("contribution"))
    return rows.select(key, F.explode(entry).alias("_e")).select(key, "_e.feature", "_e.contribution")


def margin_of(raw_prediction: str = "rawPrediction") -> Column:
    return vector_to_array(F.col(raw_prediction))[1]


def global_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, over all rows."""
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))


def top_importance(importance: DataFrame, k: int = 10) -> DataFrame:
    return importance.orderBy(F.desc("mean_abs"), "feature").limit(k)


def _factors(entries: Column, k: int, most_specific: bool) -> Column:
    """The first ``k`` of entries ``(order, feature, contribution)``, with direction and text."""
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(
        e["feature"].alias("feature"),
        F.round(e["contribution"], 4).alias("shap_value"),
        risk.direction(e["contribution"]).alias("direction"),
        risk.factor_text(e["feature"], e["contribution"], most_specific).alias("description"),
    ))


def row_factors(contributions: Column, names: Sequence[str], k: int = 3, most_specific: bool = False) -> Column:
    """The ``k`` strongest factors of a row from its array of contributions, as an array of structs;
    nothing is shuffled."""
    known = F.array(*[F.lit(n) for n in names])
    return _factors(F.transform(contributions, lambda c, i: F.struct(
        (-F.abs(c)).alias("order"), F.get(known, i).alias("feature"), c.alias("contribution"))), k, most_specific)


def top_factors(contributions: DataFrame, key: str, k: int = 3, most_specific: bool = False) -> DataFrame:
    """The same from the long form. A row has one entry per feature of the fixed feature list, so
    its list is short."""
    entry = F.struct((-F.abs("contribution")).alias("order"), "feature", "contribution")
    return contributions.groupBy(key).agg(_factors(F.collect_list(entry), k, most_specific).alias("contributing_factors"))
