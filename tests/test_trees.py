"""Trees as arrays of nodes: walks equal the fitted models, parts of a large model equal the small ones."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from tablelab.operators import models as mo
from tablelab.operators.trees import Forest, staged_scores, tree_leaves


@pytest.fixture(scope="module")
def rows(spark):
    """Two numbers and a category that decide most labels, and noise in the rest."""
    noise = F.pmod(F.xxhash64("id"), F.lit(100))
    df = spark.range(600).select(
        "id",
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).cast("double").alias("x"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(50)).cast("double").alias("z"),
        F.element_at(F.array(*map(F.lit, "abcd")), (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(4)) + 1).cast("int")).alias("kind"),
        noise.alias("noise"),
    )
    y = (((F.col("x") > 400) & (F.col("z") < 30)) | ((F.col("kind") == "b") & (F.col("x") < 200))).cast("int")
    df = df.withColumn("y", F.when(F.col("noise") < 12, 1 - y).otherwise(y))
    ready = mo.assembler(["x", "z"], ["kind"]).fit(df).transform(df)
    out = ready.select("id", "x", "z", "kind", "y", "features", F.col("y").alias("label"), F.lit(1.0).alias("weight"), F.pmod("id", F.lit(3)).cast("int").alias("fold"))
    return out.coalesce(1).cache()


def staged(spark, rows, model, sizes, boosted):
    probability, prediction = staged_scores(Forest.of(spark, model), sizes, boosted)
    out = rows.select("id", probability.alias("p"), prediction.alias("y")).orderBy("id").collect()
    return np.array([r["p"] for r in out]), np.array([r["y"] for r in out])


def scored(rows, model):
    out = model.transform(rows).select("id", vector_to_array("probability")[1].alias("p"), "prediction").orderBy("id").collect()
    return np.array([r["p"] for r in out]), np.array([r["prediction"] for r in out])


def test_first_trees_of_a_boosted_model_are_the_smaller_models(spark, rows):
    make = lambda n: GBTClassifier(maxIter=n, maxDepth=3, stepSize=0.3, seed=42, weightCol="weight").fit(rows)
    p, y = staged(spark, rows, make(10), [1, 4, 10], True)
    for k, n in enumerate((1, 4, 10)):
        want_p, want_y = scored(rows, make(n))
        np.testing.assert_allclose(p[:, k], want_p, atol=1e-12)
        assert (y[:, k] == want_y).all()


@pytest.mark.parametrize("least", [1, 10])
def test_top_of_a_tree_is_the_shallower_tree(spark, rows, least):
    make = lambda d: DecisionTreeClassifier(impurity="gini", maxDepth=d, minInstancesPerNode=least, seed=42, weightCol="weight").fit(rows)
    depths = [1, 2, 3, 5, 8]
    p, y = staged(spark, rows, make(8), depths, False)
    for k, d in enumerate(depths):
        want_p, want_y = scored(rows, make(d))
        np.testing.assert_allclose(p[:, k], want_p, atol=1e-12)
        assert (y[:, k] == want_y).all()


@pytest.mark.parametrize("metric", ["f1_macro", "roc_auc"])
@pytest.mark.parametrize("learner,grid", [("gbt", {"maxDepth": [2, 3], "maxIter": [2, 5], "stepSize": [0.1]}), ("tree", {"maxDepth": [2, 4], "minInstancesPerNode": [1, 20]})])
def test_search_equals_a_fit_of_every_point(rows, learner, grid, metric):
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight", "seed": 42}
    estimator = GBTClassifier(**common) if learner == "gbt" else DecisionTreeClassifier(impurity="gini", **common)
    maps = mo._param_grid(estimator, grid)
    found = mo.staged_search(rows, estimator, maps, mo.STAGED[learner], 3, metric)
    plain = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=mo.MacroF1(metric=metric), numFolds=3, foldCol="fold", parallelism=4).fit(rows)
    np.testing.assert_allclose(found.mean(axis=1), plain.avgMetrics, atol=1e-9)
    np.testing.assert_allclose(found.std(axis=1), plain.stdMetrics, atol=1e-9)


def test_leaf_values_sum_to_the_margin(spark, rows):
    model = GBTClassifier(maxIter=6, maxDepth=4, seed=42).fit(rows)
    walked = tree_leaves(rows, Forest.of(spark, model), ["id"])
    assert walked.count() == 600 * 6
    sums = {r["id"]: r["m"] for r in walked.groupBy("id").agg(F.sum("value").alias("m")).collect()}
    raw = {r["id"]: r["raw"] for r in model.transform(rows).select("id", vector_to_array("rawPrediction")[1].alias("raw")).collect()}
    assert raw == pytest.approx({k: 2 * v for k, v in sums.items()}) or raw == pytest.approx(sums)
    leaves = mo.leaf_rules(spark, mo.rule_table(spark, mo.Trained("y", [], None, model, {}, {}, {}, [str(i) for i in range(model.numFeatures)])))
    known = {(r["tree"], r["leaf"]) for r in leaves.collect()}
    assert {(r["tree"], r["leaf"]) for r in walked.select("tree", "leaf").distinct().collect()} <= known


def test_one_ranking_gives_test_rows_and_even_folds(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    out = mo.split_folds(df, "y", ["id"], 0.3, 5)
    assert {(r["id"], r["is_test"]) for r in out.collect()} == {(r["id"], r["is_test"]) for r in mo.split(df, "y", ["id"], 0.3).collect()}
    sizes = {(r["y"], r["fold"]): r["count"] for r in out.filter("is_test = 0").groupBy("y", "fold").count().collect()}
    for y in (0, 1):
        own = [n for (label, _), n in sizes.items() if label == y]
        assert len(own) == 5 and max(own) - min(own) <= 1
    assert out.filter("is_test = 1 AND fold IS NOT NULL").count() == 0
