"""The trees of a boosted model as arrays, and what each feature does to a row's margin.

A contribution is an occlusion difference: the margin of the row less its margin with one feature at
its typical value. Which trees a feature can change is known beforehand (an inverted index
from features to trees), and which of them it does change for a row shows on the row's own paths: a tree whose
path does not test the feature gives the same leaf either way. Only the others are walked again, past the
feature's tests, which the typical value decides once for all rows. A row that has the typical value is not
walked at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import scratch_path

#: Rows that a task walks together.
ROWS_AT_ONCE = 4096


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees in a row. A leaf has feature -1 and leads to itself; its ``value`` is its
    prediction times the weight of its tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    @staticmethod
    def of(trees: Sequence[Sequence[tuple]], weights: Sequence[float]) -> Forest:
        """From nodes ``(id, feature, threshold, left, right, prediction)``, a list per tree with the
        root as node 0; feature -1 marks a leaf."""
        feature, threshold, left, right, value, roots = [], [], [], [], [], []
        for nodes, weight in zip(trees, weights, strict=True):
            start = len(feature)
            roots.append(start)
            for number, (node, f, at, low, high, prediction) in enumerate(sorted(nodes)):
                if node != number:
                    raise ValueError("the nodes of a tree are numbered from 0 on")
                feature.append(f)
                threshold.append(at)
                left.append(start + (low if f >= 0 else node))
                right.append(start + (high if f >= 0 else node))
                value.append(prediction * weight)
        return Forest(np.array(feature, np.int64), np.array(threshold, np.float64), np.array(left, np.int64),
                      np.array(right, np.int64), np.array(value, np.float64), np.array(roots, np.int64))

    @staticmethod
    def of_model(spark, model: GBTClassificationModel) -> Forest:
        """The trees of a fitted model, as Spark stores them: a few thousand nodes, whatever the data."""
        path = scratch_path(spark, "trees")
        model.write().save(path)
        rows = spark.read.parquet(f"{path}/data").selectExpr(
            "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
            "nodeData.split.featureIndex AS feature", "nodeData.split.leftCategoriesOrThreshold AS at", "nodeData.split.numCategories AS kinds").collect()
        if any(r["feature"] >= 0 and r["kinds"] != -1 for r in rows):
            raise ValueError("a split by categories; the encodings of this library make numbers only")
        trees: dict[int, list[tuple]] = {}
        for r in rows:
            leaf = r["leftChild"] < 0
            trees.setdefault(r["treeID"], []).append(
                (r["id"], -1 if leaf else r["feature"], 0.0 if leaf else r["at"][0], r["leftChild"], r["rightChild"], r["prediction"]))
        return Forest.of([trees[k] for k in sorted(trees)], list(model.treeWeights))

    def _depth(self) -> int:
        depth, at = 0, self.roots
        while len(at := at[self.feature[at] >= 0]):
            at, depth = np.r_[self.left[at], self.right[at]], depth + 1
        return depth

    def _tested(self, features: int) -> np.ndarray:
        """For each feature and node, whether the path to the node tests the feature."""
        out, at = np.zeros((features, len(self.feature)), bool), self.roots
        while len(at := at[self.feature[at] >= 0]):
            for side in (self.left, self.right):
                out[:, side[at]] = out[:, at]
                out[self.feature[at], side[at]] = True
            at = np.r_[self.left[at], self.right[at]]
        return out

    def _past(self, feature: int, value: float) -> np.ndarray:
        """For each node the one that stands for it when the feature has this value: the node itself, or
        where its test of the feature leads."""
        out = np.arange(len(self.feature))
        while len(here := np.flatnonzero(self.feature[out] == feature)):
            node = out[here]
            out[here] = np.where(value <= self.threshold[node], self.left[node], self.right[node])
        return out


class Explainer:
    """Contributions of rows of ``x`` (rows by features)."""

    def __init__(self, forest: Forest, typical: Sequence[float]) -> None:
        self.forest, self.typical, self.depth = forest, np.asarray(typical, np.float64), forest._depth()
        tested = forest._tested(len(self.typical))
        self.past = [forest._past(f, v) for f, v in enumerate(self.typical)]
        # the inverted index: trees by feature, and the leaves of a tree that a feature's test leads to
        self.uses = tested
        stops = [*forest.roots[1:].tolist(), len(forest.feature)]
        self.trees = [[t for t, (a, b) in enumerate(zip(forest.roots.tolist(), stops, strict=True)) if tested[f, a:b].any()]
                      for f in range(len(self.typical))]

    def _walk(self, flat: np.ndarray, first: np.ndarray, node: np.ndarray, past: np.ndarray | None) -> np.ndarray:
        """Leaves reached from ``node``; ``first`` is where each row starts in ``flat``."""
        forest = self.forest
        for _ in range(self.depth):
            feature = forest.feature[node]
            # a leaf leads to itself, whatever it is asked
            low = flat[first + np.maximum(feature, 0)] <= forest.threshold[node]
            node = np.where(low, forest.left[node], forest.right[node])
            if past is not None:
                node = past[node]
        return node

    def margins_and_contributions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        forest, (n, width) = self.forest, x.shape
        flat, first = np.ascontiguousarray(x).ravel(), np.arange(n) * width
        leaves = [self._walk(flat, first, np.full(n, root), None) for root in forest.roots]
        margin = np.zeros(n)
        for leaf in leaves:
            margin += forest.value[leaf]
        out = np.zeros((n, width))
        for f, trees in enumerate(self.trees):
            other = x[:, f] != self.typical[f]
            for t in trees:
                rows = np.flatnonzero(other & self.uses[f, leaves[t]])
                if len(rows):
                    start = np.full(len(rows), self.past[f][forest.roots[t]])
                    changed = self._walk(flat, first[rows], start, self.past[f])
                    out[rows, f] += forest.value[leaves[t][rows]] - forest.value[changed]
        return margin, out


def with_contributions(rows: DataFrame, forest: Forest, typical: Sequence[float], x: str = "_x", output: str = "contributions",
                       margin: str | None = None) -> DataFrame:
    """Add the contributions of each row's array ``x``, one per entry, as an array, and on request
    the trees' ``margin``. Rows stay where they are; the trees go to the tasks. A row without ``x`` has no contributions."""
    sent = rows.sparkSession.sparkContext.broadcast((forest, list(typical)))
    schema = T.StructType([*rows.schema.fields, T.StructField(output, T.ArrayType(T.DoubleType())),
                           *([T.StructField(margin, T.DoubleType())] if margin else [])])
    width = len(typical)

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = Explainer(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                there = part[x].is_valid().to_numpy(zero_copy_only=False)
                values = part[x].drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                margins, found = use.margins_and_contributions(values)
                offsets = pa.array(np.r_[0, np.cumsum(there * width)], pa.int32(), mask=np.r_[~there, False])
                columns = [*part.columns, pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))]
                if margin:
                    spread = np.zeros(part.num_rows)
                    spread[there] = margins
                    columns.append(pa.array(spread, mask=~there))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(explained, schema)
