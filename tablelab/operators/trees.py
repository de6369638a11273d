"""Fitted trees as arrays of nodes, and rows walked through all trees of a model level by level.

One walk gives the leaf of every tree, the margin of every leading part of a boosted ensemble, and the prediction of
a tree cut at every depth. A boosted model of 50 rounds is the first 50 trees of one of 100 rounds, and a tree of
depth 3 is the top of one of depth 5, so a search fits the largest and reads the smaller ones from it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import as_column
from ..session import ensure_checkpoint_dir

#: Cells (row x tree) of one step of a walk.
STEP_CELLS = 1 << 14


def saved_nodes(spark: SparkSession, model) -> DataFrame:
    """The node rows of a fitted tree or ensemble, as it saves them to the shared folder, or of a grown one."""
    if isinstance(model, GrownModel):
        return model.nodes(spark)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.save(folder)
    nodes = spark.read.parquet(f"{folder}/data")
    if "nodeData" in nodes.columns:
        return nodes.select(F.col("treeID").alias("tree"), "nodeData.*")
    return nodes.select(F.lit(0).alias("tree"), "*")


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees of a model, one array cell per node, tree after tree; children are -1 for leaves."""

    roots: np.ndarray
    number: np.ndarray  # of the node in its tree
    feature: np.ndarray
    threshold: np.ndarray
    by_category: np.ndarray
    goes_left: np.ndarray  # (node, category)
    left: np.ndarray
    right: np.ndarray
    prediction: np.ndarray
    share: np.ndarray  # of class 1 among a node's rows, by weight; for classifying trees
    weights: np.ndarray  # of the trees
    # Of grown trees only: gain of the split, weight and (if counted) number of the rows of each node.
    gain: np.ndarray | None = None
    weight: np.ndarray | None = None
    rows: np.ndarray | None = None

    @staticmethod
    def of(spark: SparkSession, model) -> Forest:
        if isinstance(model, GrownModel):
            return model.forest
        nodes = sorted(saved_nodes(spark, model).collect(), key=lambda r: (r["tree"], r["id"]))  # model size, not data size
        trees = np.array([r["tree"] for r in nodes])
        roots = np.flatnonzero(np.concatenate([[True], np.diff(trees) != 0]))
        at = {(r["tree"], r["id"]): k for k, r in enumerate(nodes)}
        child = lambda c: np.array([at[r["tree"], r[c]] if r["leftChild"] >= 0 else -1 for r in nodes])
        arity = np.array([max(r["split"]["numCategories"], 0) if r["leftChild"] >= 0 else 0 for r in nodes])
        goes_left = np.zeros((len(nodes), max(int(arity.max(initial=0)), 1)), bool)
        threshold = np.zeros(len(nodes))
        for k, r in enumerate(nodes):
            values = r["split"]["leftCategoriesOrThreshold"] or []
            if arity[k]:
                goes_left[k, np.array(values, np.int64)] = True
            elif r["leftChild"] >= 0:
                threshold[k] = values[0]
        stats = [r["impurityStats"] for r in nodes]
        return Forest(
            roots, np.array([r["id"] for r in nodes]), np.array([r["split"]["featureIndex"] for r in nodes]), threshold, arity > 0, goes_left,
            child("leftChild"), child("rightChild"), np.array([r["prediction"] for r in nodes], float),
            np.array([s[1] / sum(s) if len(s) == 2 and sum(s) else 0.0 for s in stats]),
            np.array(getattr(model, "treeWeights", [1.0]), float),
        )

    def levels(self, values: np.ndarray) -> Iterator[np.ndarray]:
        """Nodes (row, tree) that rows of features reach after each step; the last are leaves."""
        at, own = np.tile(self.roots, (len(values), 1)), np.arange(len(self.left))
        rows = np.arange(len(values))[:, None]
        inner = self.left >= 0
        left, right = np.where(inner, self.left, own), np.where(inner, self.right, own)  # a leaf leads to itself
        while True:
            yield at
            if not inner[at].any():
                return
            value = values[rows, self.feature[at]]
            goes = value <= self.threshold[at]
            if self.by_category.any():
                category = np.clip(np.nan_to_num(value), 0, self.goes_left.shape[1] - 1).astype(np.int64)
                goes = np.where(self.by_category[at], self.goes_left[at, category], goes)
            at = np.where(goes, left[at], right[at])

    def leaves(self, values: np.ndarray) -> np.ndarray:
        """Leaves (row, tree)."""
        *_, last = self.levels(values)
        return last

    def margins(self, values: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
        """Sums (row, size) of the weighted leaf values of the first so many trees."""
        sums = np.cumsum(self.prediction[self.leaves(values)] * self.weights, axis=1)
        return sums[:, np.minimum(np.array(sizes), len(self.roots)) - 1]

    def cut(self, depth: int) -> Forest:
        """The tree that a fit of that depth gives: deeper nodes go, and parents of leaves of one class become leaves."""
        level, left = np.zeros(len(self.left), np.int64), self.left.copy()
        order = [int(self.roots[0])]
        for k in order:
            if level[k] >= depth:
                left[k] = -1
            elif left[k] >= 0:
                level[[self.left[k], self.right[k]]] = level[k] + 1
                order += [int(self.left[k]), int(self.right[k])]
        for k in reversed(order):
            a, b = self.left[k], self.right[k]
            if left[k] >= 0 and left[a] < 0 and left[b] < 0 and self.prediction[a] == self.prediction[b]:
                left[k] = -1
        return Forest(**{**self.__dict__, "left": left})


_NODES = """tree int, id int, prediction double, rawCount bigint, gain double, leftChild int, rightChild int,
split struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>"""


@dataclass(frozen=True)
class GrownModel:
    """A boosted model whose trees were grown together (``growth``). It scores rows as Spark's model of the same trees."""

    forest: Forest
    numFeatures: int

    def transform(self, dataset: DataFrame) -> DataFrame:
        """Add ``rawPrediction``, ``probability`` and ``prediction`` by the column ``features``."""
        margin = _mapped(lambda x: self.forest.margins(x, [len(self.forest.roots)]), "array<double>", self.forest)
        rows = dataset.withColumn("_margin", margin(vector_to_array("features"))[0])
        m, p = F.col("_margin"), 1.0 / (1.0 + F.exp(-2.0 * F.col("_margin")))
        vectors = {"rawPrediction": array_to_vector(F.array(-m, m)), "probability": array_to_vector(F.array(1.0 - p, p))}
        return rows.withColumns(vectors | {"prediction": (m > 0).cast("double")}).drop("_margin")

    @property
    def featureImportances(self) -> DenseVector:
        """Share of each feature in the gains of all splits, weighted by the rows' weights."""
        f, inner = self.forest, self.forest.left >= 0
        gains = np.bincount(f.feature[inner], (f.gain * f.weight)[inner], self.numFeatures)
        return Vectors.dense(gains / gains.sum() if gains.sum() > 0 else gains)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row per node, as Spark saves them."""
        f, inner = self.forest, self.forest.left >= 0
        tree = np.searchsorted(f.roots, np.arange(len(f.left)), "right") - 1
        left, right = (np.where(inner, f.number[c], -1).tolist() for c in (f.left, f.right))
        splits = [(k, [v], -1) if i else (-1, [], -1) for k, v, i in zip(f.feature.tolist(), f.threshold.tolist(), inner)]
        gain = np.where(inner, f.gain, -1.0).tolist()
        return spark.createDataFrame(list(zip(tree.tolist(), f.number.tolist(), f.prediction.tolist(), f.rows.tolist(), gain, left, right, splits)), _NODES)


def _matrix(features: pa.Array) -> np.ndarray:
    return features.flatten().to_numpy().reshape(len(features), -1)


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.ravel()))


def _mapped(function, kind: str, forest: Forest):
    """A column function over feature arrays that walks a few rows at a time."""

    @F.arrow_udf(kind)
    def walk(features: pa.Array) -> pa.Array:
        step = max(1, STEP_CELLS // max(len(forest.roots), 1))
        parts = [function(_matrix(features.slice(i, step))) for i in range(0, len(features), step)]
        return pa.concat_arrays([_lists(p) for p in parts]) if parts else pa.array([], pa.list_(pa.float64()))

    return walk


def staged_scores(forest: Forest, sizes: Sequence[int], boosted: bool, values: Column | None = None) -> tuple[Column, Column]:
    """Arrays (probability of class 1, prediction) over the column ``features`` for each size of the model.

    A size is a number of trees of a boosted model, or a depth of a single tree. ``values`` may be features as an array.
    """
    values = vector_to_array("features") if values is None else values
    if boosted:
        margin = _mapped(lambda x: forest.margins(x, sizes), "array<double>", forest)(values)
        return F.transform(margin, lambda m: 1.0 / (1.0 + F.exp(-2.0 * m))), F.transform(margin, lambda m: (m > 0).cast("int"))
    trees = [forest.cut(d) for d in sizes]

    def reached(x: np.ndarray) -> np.ndarray:
        at = [t.leaves(x)[:, 0] for t in trees]
        return np.stack([f[a] for f in (forest.share, forest.prediction) for a in at], axis=1)

    both = _mapped(reached, "array<double>", forest)(values)
    n = len(sizes)
    return F.slice(both, 1, n), F.transform(F.slice(both, n + 1, n), lambda p: p.cast("int"))


def tree_leaves(df: DataFrame, forest: Forest, keep: Sequence[str]) -> DataFrame:
    """(keep, tree, leaf, value): the leaf that each row reaches in each tree, and its weighted prediction.

    ``df`` has the assembled ``features``. Summed over a boosted model's trees the values are the row's margin.
    """

    def reached(x: np.ndarray) -> np.ndarray:
        return forest.leaves(x).astype(np.int64)

    at = _mapped(reached, "array<bigint>", forest)(vector_to_array("features"))
    rows = df.select(*[as_column(k) for k in keep], F.posexplode(at).alias("tree", "_at"))
    number, value = F.lit(forest.number.tolist()), F.lit(forest.prediction.tolist())
    weight = F.lit(forest.weights.tolist())
    return rows.select(
        *[as_column(k) for k in keep], "tree", F.get(number, F.col("_at").cast("int")).alias("leaf"),
        (F.get(value, F.col("_at").cast("int")) * F.get(weight, F.col("tree"))).alias("value"),
    )
