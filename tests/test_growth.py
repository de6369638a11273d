"""Models grown together equal fits of their own, and cost jobs by level and not by model."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablelab.operators import growth, sensitivity
from tablelab.operators import models as mo
from tablelab.operators.evaluate import metrics
from tablelab.operators.trees import Forest, staged_scores

BOOSTED = {"maxIter": 3, "maxDepth": 2, "stepSize": 0.2, "seed": 42}


@pytest.fixture(scope="module")
def rows(spark):
    """Repeated rows of two features that decide the label but for some noise, one that does not, two fold columns."""
    draw = lambda i, n: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(n))
    df = spark.range(400).select("id", draw(1, 60).cast("double").alias("x"), draw(2, 12).cast("double").alias("z"), draw(3, 9).cast("double").alias("other"), draw(4, 100).alias("noise"))
    y = ((F.col("x") > 25) & (F.col("z") < 8)).cast("int")
    df = df.withColumn("y", F.when(F.col("noise") < 10, 1 - y).otherwise(y)).crossJoin(spark.range(2).select(F.col("id").alias("copy")))
    df = df.withColumns({f"_fold{r}": F.pmod(F.xxhash64("id", "copy", F.lit(r)), F.lit(2)).cast("int") for r in range(2)})
    ready = VectorAssembler(inputCols=["x", "z", "other"], outputCol="features").transform(df)
    return ready.select("x", "z", "other", "y", "features", F.col("y").alias("label"), F.lit(1.0).alias("weight"), "_fold0", "_fold1").coalesce(1).cache()


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_few_cells_cost_a_fixed_number_of_jobs(spark, rows):
    """However many rounds and levels a search has."""
    counts = []
    for depth, rounds in ((2, 3), (4, 12)):
        plans = [growth.Plan(f, depth, rounds, column="_fold0") for f in range(2)]
        counts.append(jobs(spark, f"depth{depth}", lambda plans=plans: growth.grow(rows, plans, True))[1])
    assert counts[1] <= counts[0]  # the first caches the rows


@pytest.mark.parametrize("boosted", [True, False])
def test_models_grown_alone_and_spread_are_the_same(monkeypatch, rows, boosted):
    plans = [growth.Plan(f, d, 4 if boosted else 1, least=n, column="_fold0") for f in range(2) for d, n in ((2, 1), (4, 20))]
    alone, _ = growth.grow(rows, plans, boosted)
    monkeypatch.setattr(growth, "ALONE", 0)
    spread, _ = growth.grow(rows, plans, boosted)
    for a, b in zip(alone, spread, strict=True):
        assert (a.feature == b.feature).all() and (a.threshold == b.threshold).all() and (a.left == b.left).all()
        np.testing.assert_allclose(a.prediction, b.prediction, atol=1e-12)


def test_kept_model_equals_the_fit_on_all_rows(spark, rows):
    estimator = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", **BOOSTED)
    ready = rows.withColumn("fold", F.col("_fold0")).withColumn("weight", F.when(F.col("label") == 1, 2.5).otherwise(1.0))
    got, want = mo.fitted(ready, estimator, {estimator.maxIter: 5}), estimator.fit(ready, {estimator.maxIter: 5})
    assert not isinstance(got, type(want))
    np.testing.assert_allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=1e-9)
    read = lambda m: [(r[0].toArray().tolist(), r[1].toArray().tolist(), r[2]) for r in m.transform(rows).select("rawPrediction", "probability", "prediction").collect()]
    for a, b in zip(read(got), read(want), strict=True):
        assert a[0] == pytest.approx(b[0]) and a[1] == pytest.approx(b[1]) and a[2] == b[2]
    names = ["x", "z", "other"]
    rules = [mo.rule_table(spark, mo.Trained("y", names, None, m, {}, {}, {}, names)).orderBy("tree", "node").collect() for m in (got, want)]
    for a, b in zip(*rules, strict=True):
        assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in a.asDict().items()} == b.asDict()


def test_jobs_follow_levels_and_not_models(spark, rows):
    few = [growth.Plan(f, 2, 3, column="_fold0") for f in range(2)]
    many = [growth.Plan(f, 2, 3, step=s, column="_fold0") for f in range(2) for s in (0.1, 0.2, 0.3, 0.4)]
    _, one = jobs(spark, "few", lambda: growth.grow(rows, few, True))
    (forests, _), other = jobs(spark, "many", lambda: growth.grow(rows, many, True))
    assert len(forests) == 8 and other < 2 * one


@pytest.mark.parametrize("least", [1, 40])
def test_rows_that_are_counted_together_keep_their_number(spark, rows, least):
    estimator = DecisionTreeClassifier(impurity="gini", maxDepth=4, minInstancesPerNode=least, seed=42, weightCol="weight")
    (forest,), _ = growth.grow(rows, [growth.planned(estimator, {}, 1, "_fold0")], False)
    probability, prediction = staged_scores(forest, [4], False)
    want = Forest.of(spark, estimator.fit(rows.filter("_fold0 <> 1")))
    share, said = staged_scores(want, [4], False)
    for got in rows.select(probability[0], prediction[0], share[0], said[0]).collect():
        assert got[0] == pytest.approx(got[2], abs=1e-12) and got[1] == got[3]


def test_refits_equal_fits_of_their_own(rows):
    tasks = [("_fold0", 0, [0, 1, 2]), ("_fold1", 1, [0, 1, 2]), ("_fold0", 1, [1, 2])]
    estimator = GBTClassifier(featuresCol="features", labelCol="label", **BOOSTED)
    found = sensitivity.refits(rows, estimator, tasks)
    for (column, fold, among), got in zip(tasks, found, strict=True):
        some = rows.drop("features")
        some = VectorAssembler(inputCols=[["x", "z", "other"][i] for i in among], outputCol="features").transform(some)
        held = estimator.fit(some.filter(F.col(column) != fold)).transform(some.filter(F.col(column) == fold))
        want = metrics(held.select("label", F.col("prediction").cast("int").alias("prediction"))).first().asDict()
        assert got == pytest.approx(want, abs=1e-12)


def test_settings_that_only_spark_knows_are_fitted_by_spark(rows):
    estimator = GBTClassifier(featuresCol="features", labelCol="label", subsamplingRate=0.9, **BOOSTED)
    assert growth.planned(estimator, {}, 0) is None
    (found,) = sensitivity.refits(rows, estimator, [("_fold0", 0, [0, 1])])
    assert found["accuracy"] > 0.5
    maps = mo._param_grid(estimator, {"maxIter": [1, 3]})
    assert mo.staged_search(rows.withColumn("fold", F.col("_fold0")), estimator, maps, "maxIter", 2).shape == (2, 2)


def test_no_row_is_seen(spark, rows):
    """All rows stand in the held-out fold."""
    forests, counted = growth.grow(rows.withColumn("fold", F.lit(0)), [growth.Plan(0, 2, 2)], True)
    assert len(forests[0].roots) == 2 and np.all(forests[0].prediction == 0)
    assert counted["fold"].agg(F.sum("n")).first()[0] == rows.count()
