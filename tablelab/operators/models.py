"""Tree classifiers through Spark ML: split, folds, weights, grid search, importances and rule tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conditions import complete_cases
from ..functions.nulls import as_column
from ..functions.order import stratified_rank
from ..session import checkpointed, ensure_checkpoint_dir
from .evaluate import metrics, roc_auc
from .growth import grow, planned, two_classes
from .profile import trainable
from .trees import Forest, GrownModel, saved_nodes, staged_scores

# --- rows -----------------------------------------------------------------------------------------


def feature_columns(df: DataFrame, wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """(features that exist, missing ones); an error if none exists."""
    here = [c for c in dict.fromkeys(wanted) if c in df.columns]
    if not here:
        raise ValueError("none of the listed features exists")
    return here, [c for c in wanted if c not in df.columns]


def split(
    df: DataFrame, label: str, keys: Sequence[str], test_share: float = 0.3, seed: int = 42, method: str = "xxhash64"
) -> DataFrame:
    """Add ``is_test``: the lowest share of hash ranks inside each label, the same under any partitioning."""
    ranked = stratified_rank(df, label, keys, seed, method)
    test = F.col("_rank") < F.lit(float(test_share)) * (F.col("_size") - 1)
    return ranked.withColumn("is_test", test.cast("int")).drop("_rank", "_size")


def folds(
    df: DataFrame, label: str, keys: Sequence[str], k: int = 5, seed: int = 42, method: str = "xxhash64", name: str = "fold"
) -> DataFrame:
    """Add the fold number 0..k-1: hash ranks inside each label modulo k."""
    ranked = stratified_rank(df, label, keys, seed, method)
    return ranked.withColumn(name, (F.col("_rank") % k).cast("int")).drop("_rank", "_size")


def split_folds(
    df: DataFrame, label: str, keys: Sequence[str], test_share: float = 0.3, k: int = 5, seed: int = 42, method: str = "xxhash64"
) -> DataFrame:
    """Add ``is_test`` as ``split`` does, and the ``fold`` of the other rows, both from one ranking."""
    ranked = stratified_rank(df, label, keys, seed, method)
    test = F.col("_rank") < F.lit(float(test_share)) * (F.col("_size") - 1)
    # Ranks of the other rows go on from those of the test rows, so their remainders are as even.
    return ranked.select(
        *[as_column(c) for c in df.columns], test.cast("int").alias("is_test"), F.when(~test, F.col("_rank") % k).cast("int").alias("fold")
    )


def class_weight(df: DataFrame, label: str, kind: str = "ratio") -> Column:
    """'ratio': positives weigh negatives / positives; 'balanced': n / (2 * class size)."""
    counts = {r[0]: r[1] for r in df.groupBy(as_column(label)).count().collect()}
    neg, pos = counts.get(0, 0), counts.get(1, 0)
    is_pos = as_column(label) == 1
    if kind == "ratio":
        return F.when(is_pos, F.lit(neg / pos if pos else 1.0)).otherwise(F.lit(1.0))
    if kind == "balanced":
        n = neg + pos
        return F.when(is_pos, F.lit(n / (2 * pos) if pos else 1.0)).otherwise(F.lit(n / (2 * neg) if neg else 1.0))
    raise ValueError(f"unknown class weighting: {kind}")


def one_hot(columns: Sequence[str]) -> list:
    """Stages turning category columns into 0/1 vectors; categories unseen in the fit get their own index."""
    return [
        StringIndexer(inputCols=list(columns), outputCols=[f"{c}_index" for c in columns], handleInvalid="keep"),
        OneHotEncoder(
            inputCols=[f"{c}_index" for c in columns], outputCols=[f"{c}_onehot" for c in columns], dropLast=True
        ),
    ]


def assembler(numeric: Sequence[str], categorical: Sequence[str] = ()) -> Pipeline:
    stages = one_hot(categorical) if categorical else []
    inputs = [*numeric, *[f"{c}_onehot" for c in categorical]]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features")])


class MacroF1(Evaluator):
    """Mean F1 of both classes (Spark's own 'f1' weights by class size), or another figure of ``metrics`` or the AUC."""

    def __init__(self, label: str = "label", prediction: str = "prediction", metric: str = "f1_macro"):
        super().__init__()
        self._label, self._prediction, self._metric = label, prediction, metric

    def _evaluate(self, dataset: DataFrame) -> float:
        if self._metric == "roc_auc":
            scored = dataset.withColumn("probability", vector_to_array("probability")[1])
            return float(roc_auc(scored, label=self._label).first()["roc_auc"] or 0.0)
        return float(metrics(dataset, label=self._label, prediction=self._prediction).first()[self._metric])

    def isLargerBetter(self) -> bool:
        return True


# --- training ---------------------------------------------------------------------------------------


@dataclass
class Trained:
    label: str
    features: list[str]
    prepare: PipelineModel
    model: object
    metrics: dict[str, float | None]
    best_params: dict[str, object]
    importances: dict[str, float]
    vector_names: list[str]
    scored_test: DataFrame = field(repr=False, default=None)

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` of class 1 and the 0/1 ``prediction``."""
        return score(df, self.prepare, self.model)


def score(df: DataFrame, prepare: PipelineModel, model) -> DataFrame:
    out = model.transform(prepare.transform(df.drop("prediction", "probability", "rawPrediction", "features")))
    return (
        out.withColumn("probability", vector_to_array("probability")[1])
        .withColumn("prediction", F.col("prediction").cast("int"))
        .drop("rawPrediction", "features")
    )


def _param_grid(estimator, grid: Mapping[str, Sequence]) -> list:
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(estimator, name), list(values))
    return builder.build()


# Default grids of the two learners.
GBT_GRID = {"maxDepth": (3, 5, 7), "maxIter": (50, 100), "stepSize": (0.1, 0.3)}
TREE_GRID = {"maxDepth": (2, 3, 4, 5), "minInstancesPerNode": (5, 10, 20)}


#: The parameter of each learner whose smaller values are parts of the model of the largest.
STAGED = {"gbt": "maxIter", "tree": "maxDepth"}
#: Rows of a partition of the rows that are fitted: a fit is thousands of short jobs over all of them.
FIT_ROWS = 100_000


def staged_search(
    rows: DataFrame, estimator, maps: Sequence[Mapping], staged: str, k: int, metric: str = "f1_macro", parallelism: int | None = None
) -> np.ndarray:
    """The metric of every grid point (first axis) on every fold.

    ``rows`` have features, label, weight and fold. Points that differ in the ``staged`` parameter alone share one
    fit a fold, at its largest value: the models of the smaller values are read from it. The fits go on together
    (``growth``); only those with settings that it does not know are Spark's, one by one.
    """
    spark = rows.sparkSession
    boosted = staged == "maxIter"
    param = getattr(estimator, staged)
    groups: dict[tuple, list[int]] = {}
    for i, point in enumerate(maps):
        groups.setdefault(tuple(sorted((p.name, v) for p, v in point.items() if p != param)), []).append(i)
    out = np.zeros((len(maps), k))
    sizes_of = lambda points: [maps[i].get(param, estimator.getOrDefault(param)) for i in points]
    # The largest models first, so that none is left for the end.
    tasks = sorted(((g, f) for g in groups.values() for f in range(k)), key=lambda t: -max(maps[t[0][0]].get(estimator.maxDepth, 0), 0))
    plans = [planned(estimator, {**maps[points[0]], param: max(sizes_of(points))}, fold) for points, fold in tasks]
    together = all(plans) and two_classes(rows)
    forests, counted = grow(rows, plans, boosted) if together else ([None] * len(tasks), {})

    def run(task: tuple[list[int], int], forest: Forest | None) -> None:
        points, fold = task
        sizes = sizes_of(points)
        if forest is None:
            forest = Forest.of(spark, estimator.fit(rows.filter(F.col("fold") != fold), {**maps[points[0]], param: max(sizes)}))
            table, values = rows.withColumn("n", F.lit(1)), None
        else:
            table, values = counted["fold"], F.col("features")
        probability, prediction = staged_scores(forest, sizes, boosted, values)
        stages = F.arrays_zip(probability.alias("p"), prediction.alias("y")).alias("_stages")
        held = table.filter(F.col("fold") == fold).select(F.col("label").cast("int").alias("label"), "n", stages)
        held = held.select("label", "n", F.posexplode("_stages").alias("stage", "_s")).select("label", "n", "stage", F.col("_s.p").alias("probability"), F.col("_s.y").alias("prediction"))
        figures = roc_auc(held, by=["stage"], n="n") if metric == "roc_auc" else metrics(held, by=["stage"], n="n")
        for r in figures.collect():
            out[points[r["stage"]], fold] = r[metric] or 0.0

    in_parallel(lambda t: run(*t), list(zip(tasks, forests, strict=True)), rows, parallelism or (PARALLEL_FITS[0] if together else None))
    return out


#: A fold number that no row has.
NO_FOLD = -1


def fitted(rows: DataFrame, estimator, point: Mapping, categories: bool = False):
    """The model of a grid point on all rows.

    Boosted trees grow on the rows counted together, as those of the search, and not in a pass over all rows for each
    level of each tree. A single tree is Spark's fit, and so are models with settings that ``growth`` does not know and
    those whose rules name categories.
    """
    plan = planned(estimator, point, NO_FOLD) if estimator.hasParam("maxIter") and not categories else None
    if plan is None or not two_classes(rows):
        return estimator.fit(rows, point)
    (forest,), _ = grow(rows, [replace(plan, count=True)], True)
    return GrownModel(forest, rows.first()["features"].size)


#: Fits that run beside each other, over rows of one partition and of more. A fit of one partition keeps one core busy
#: for a fraction of the time; one of many partitions holds its rows in memory. Grown models only score counted rows.
PARALLEL_FITS = (16, 4)


def in_parallel(run, tasks: Sequence, rows: DataFrame, parallelism: int | None = None) -> list:
    """``run`` for each task in threads of the driver, each of which waits for the jobs of its own fit."""
    if parallelism is None:
        parallelism = PARALLEL_FITS[rows.rdd.getNumPartitions() > 1]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(inheritable_thread_target(rows.sparkSession)(run), tasks))


def few_partitions(df: DataFrame, rows: int) -> DataFrame:
    """As few partitions as the rows ask for: a fit is thousands of jobs that each go over all of them."""
    return df.coalesce(max(1, math.ceil(rows / FIT_ROWS)))


def train(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    learner: str = "gbt",
    grid: Mapping[str, Sequence] | None = None,
    k: int = 5,
    test_share: float = 0.3,
    seed: int = 42,
    weighting: str | None = None,
    parallelism: int | None = None,
    categorical: Sequence[str] = (),
    metric: str = "f1_macro",
) -> Trained:
    """Split, grid search with stratified folds on ``metric``, refit, score the test rows.

    The scored test rows are written once to the shared folder, as many tables are made from them.
    """
    rows = complete_cases(df.select(*dict.fromkeys([*keys, *features, *categorical, label])), [*features, label])
    parts = split_folds(rows, label, keys, test_share, k, seed).persist(StorageLevel.MEMORY_AND_DISK)
    train_rows, test_rows = parts.filter("is_test = 0"), parts.filter("is_test = 1")
    weighting = weighting or ("ratio" if learner == "gbt" else "balanced")
    weighted = train_rows.withColumn("weight", class_weight(train_rows, label, weighting))
    prepare = assembler(features, categorical).fit(train_rows)
    fit_rows = prepare.transform(weighted).select("features", as_column(label).alias("label"), "weight", "fold")
    fit_rows = few_partitions(fit_rows, train_rows.count()).persist(StorageLevel.MEMORY_AND_DISK)
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight", "seed": seed}
    if learner == "gbt":
        ensure_checkpoint_dir(df.sparkSession)
        estimator = GBTClassifier(**common)
    elif learner == "tree":
        estimator = DecisionTreeClassifier(impurity="gini", **common)
    else:
        raise ValueError(f"unknown learner: {learner}")
    maps = _param_grid(estimator, grid or (GBT_GRID if learner == "gbt" else TREE_GRID))
    found = staged_search(fit_rows, estimator, maps, STAGED[learner], k, metric, parallelism)
    means, spreads = found.mean(axis=1), found.std(axis=1)
    best = int(np.argmax(means))
    model = fitted(fit_rows, estimator, maps[best], bool(categorical))
    names = _vector_names(prepare.transform(train_rows.limit(1)), features, categorical)
    importances = dict(zip(names, (float(v) for v in model.featureImportances.toArray())))
    scored = checkpointed(score(test_rows, prepare, model))
    figures = metrics(scored, label=label).first().asDict()
    figures["roc_auc"] = roc_auc(scored, label=label).first()["roc_auc"]
    figures["cv_mean"], figures["cv_std"] = float(means[best]), float(spreads[best])
    fit_rows.unpersist()
    parts.unpersist()
    return Trained(
        label,
        list(features),
        prepare,
        model,
        figures,
        {p.name: v for p, v in maps[best].items()},
        dict(sorted(importances.items(), key=lambda x: -x[1])),
        names,
        scored,
    )


def _vector_names(assembled: DataFrame, features: Sequence[str], categorical: Sequence[str]) -> list[str]:
    if not categorical:
        return list(features)
    attrs = assembled.schema["features"].metadata["ml_attr"]["attrs"]
    flat = sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)
    return [name for _, name in flat]


def train_each(df: DataFrame, features: Sequence[str], labels: Sequence[str], keys: Sequence[str], minimum: int = 5, **options):
    """({label: Trained}, {label: reason it was skipped}); each fit is distributed, labels follow each other."""
    done: dict[str, Trained] = {}
    skipped: dict[str, str] = {}
    rows = complete_cases(df, features)
    for label in labels:
        balance = {r[0]: r[1] for r in rows.groupBy(as_column(label)).count().collect()}
        reason = trainable(balance, minimum)
        if reason:
            skipped[label] = reason
        else:
            done[label] = train(rows, features, label, keys, **options)
    return done, skipped


# --- what the model learned --------------------------------------------------------------------------


def importance_table(spark: SparkSession, trained: Trained, top: int | None = None) -> DataFrame:
    rows = list(trained.importances.items())[:top]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def rule_table(spark: SparkSession, trained: Trained) -> DataFrame:
    """One row per tree node: feature and threshold of the split (left: <=), children, prediction, gain, rows.

    A split by category has its left categories in ``categories`` and no threshold.

    Read back from Spark's saved node data in the shared folder, or taken from a grown model.
    """
    nodes = saved_nodes(spark, trained.model)
    names = F.lit(trained.vector_names)
    leaf = F.col("leftChild") < 0
    by_category = F.col("split.numCategories") > 0
    nodes = nodes.select(
        "tree",
        F.col("id").alias("node"),
        F.when(~leaf, F.get(names, F.col("split.featureIndex"))).alias("feature"),
        F.when(~leaf & ~by_category, F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0))).alias("threshold"),
        F.when(~leaf & by_category, F.array_sort("split.leftCategoriesOrThreshold")).alias("categories"),
        F.when(~leaf, F.col("leftChild")).alias("left"),
        F.when(~leaf, F.col("rightChild")).alias("right"),
        "prediction",
        F.when(~leaf, F.col("gain")).alias("gain"),
        F.col("rawCount").alias("count"),
    )
    parents = nodes.filter(F.col("left").isNotNull()).select(
        F.col("tree").alias("_t"), F.col("node").alias("parent"), F.explode(F.array("left", "right")).alias("_c")
    )
    return nodes.join(parents, (F.col("tree") == F.col("_t")) & (F.col("node") == F.col("_c")), "left").drop("_t", "_c")


def leaf_rules(spark: SparkSession, rules: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(tree, leaf, predicate, prediction): root-to-leaf paths as SQL predicates, cut at ``max_depth`` if given."""
    nodes = {(r["tree"], r["node"]): r for r in rules.collect()}  # model size, not data size
    rows = []

    def walk(tree: int, node: int, path: list[str]) -> None:
        r = nodes[tree, node]
        if r["left"] is None or (max_depth is not None and len(path) >= max_depth):
            rows.append((tree, node, " AND ".join(path) or "true", float(r["prediction"])))
            return
        if r["categories"] is not None:
            among = ", ".join(f"{v!r}D" for v in r["categories"])
            left, right = f"`{r['feature']}` IN ({among})", f"`{r['feature']}` NOT IN ({among})"
        else:
            left, right = f"`{r['feature']}` <= {r['threshold']!r}D", f"`{r['feature']}` > {r['threshold']!r}D"
        walk(tree, r["left"], [*path, left])
        walk(tree, r["right"], [*path, right])

    for tree, node in sorted(k for k, r in nodes.items() if r["parent"] is None):
        walk(tree, node, [])
    return spark.createDataFrame(rows, "tree int, leaf int, predicate string, prediction double")


def split_importance(rules: DataFrame) -> DataFrame:
    """Splits and total gain per feature."""
    return (
        rules.filter(F.col("feature").isNotNull())
        .groupBy("feature")
        .agg(F.count("*").alias("splits"), F.sum("gain").alias("gain"))
    )


def split_ranges(rules: DataFrame) -> DataFrame:
    """All split thresholds of each feature with the suggested range (4 places); splits by category have none."""
    return (
        rules.filter(F.col("threshold").isNotNull())
        .groupBy("feature")
        .agg(
            F.sort_array(F.collect_list("threshold")).alias("thresholds"),
            F.min("threshold").alias("min_threshold"),
            F.max("threshold").alias("max_threshold"),
        )
        .withColumn("suggested_low", F.round("min_threshold", 4))
        .withColumn("suggested_high", F.round("max_threshold", 4))
    )


def used_value_ranges(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Min, max, mean, std over all rows of the features the trees use with positive gain."""
    used = [r[0] for r in rules.filter(F.col("gain") > 0).select("feature").distinct().collect()]
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"s{i}.col1").alias("min"), F.col(f"s{i}.col2").alias("max"),
            F.col(f"s{i}.col3").alias("mean"), F.col(f"s{i}.col4").alias("std"),
        )
        for i, c in enumerate(used)
    ]
    aggs = []
    for i, c in enumerate(used):
        v = as_column(c).cast("double")
        aggs.append(F.struct(F.min(v), F.max(v), F.avg(v), F.stddev_samp(v)).alias(f"s{i}"))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def compare(spark: SparkSession, models: Mapping[str, Trained], top: int = 3) -> DataFrame:
    """One row per label: F1, AUC, precision, recall and the leading features."""
    rows = [
        (n, m.metrics["f1_macro"], m.metrics["roc_auc"], m.metrics["precision"], m.metrics["recall"], list(m.importances)[:top])
        for n, m in models.items()
    ]
    return spark.createDataFrame(
        rows, "label string, f1_macro double, roc_auc double, precision double, recall double, top_features array<string>"
    ).orderBy(F.col("f1_macro").desc(), "label")

