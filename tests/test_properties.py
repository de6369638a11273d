"""Statistics and models against brute force, and properties that must hold for any input."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablelab.functions.hashing import standard_normal, uniform
from tablelab.functions.order import stratified_rank
from tablelab.operators import evaluate as ev
from tablelab.operators import models as mo
from tablelab.operators import profile as pr
from tablelab.operators import sensitivity as se
from tablelab.operators import stats as st

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0 if i < 70 else 1, *map(float, rng.normal(size=3))) for i in range(100)] + [(100, 1, None, 1.0, 1.0)]
    return spark.createDataFrame(rows, "id long, g int, a double, b double, c double").cache()


def brute_pairs(points, fit):
    out = {}
    for r in points.dropna().collect():
        z = [(r[c] - fit[c][0]) / fit[c][1] for c in COLS]
        out.setdefault(r["g"], []).append(z)
    values = {}
    for g, rows in out.items():
        z = np.array(rows)
        i, j = np.triu_indices(len(z), 1)
        d = np.sqrt(((z[i] - z[j]) ** 2).sum(axis=1))
        cos = (z[i] * z[j]).sum(axis=1) / np.linalg.norm(z[i], axis=1) / np.linalg.norm(z[j], axis=1)
        values[g] = {"euclidean": 1 / (1 + d), "cosine": cos}
    return values


def test_similarity_equals_brute_force(points):
    want = brute_pairs(points, st.fit_scaling(points.dropna(), COLS))
    exact = {r["label"]: r for r in st.cosine_similarity(points, "g", COLS).collect()}
    groups = sorted(want, key=str)
    flags = points.dropna().withColumns({f"in_{k}": F.col("g").eqNullSafe(F.lit(g)).cast("int") for k, g in enumerate(groups)})
    apart = {r["label"]: r for r in st.similarity_comparison(flags, [f"in_{k}" for k in range(len(groups))], COLS).collect()}
    for k, g in enumerate(groups):
        v, squares = want[g]["cosine"], (1 / want[g]["euclidean"] - 1) ** 2
        if not len(v):
            continue
        r, pair = exact[g], apart[f"in_{k}"]
        assert (r["cosine_mean"], r["cosine_std"]) == pytest.approx((v.mean(), v.std()), abs=1e-9)
        assert (pair["cosine_mean"], pair["squared_distance_mean"]) == pytest.approx((v.mean(), squares.mean()), abs=1e-9)


def test_wide_correlation_takes_one_scan_of_tasks(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(300, 40)) * 10.0 ** rng.integers(-3, 3, 40) + 10.0 ** rng.integers(0, 8, 40)
    data[:, 7] = 5.5
    frame = pd.DataFrame(data, columns=[f"c{i}" for i in range(40)])
    frame.loc[rng.random(300) < 0.2, "c3"] = np.nan
    frame["all_null"] = np.nan
    df = spark.createDataFrame(frame).replace(float("nan"), None)
    got = {(r["a"], r["b"]): r["r"] for r in st.correlation_matrix(df, list(frame)).collect()}
    want = frame.corr()
    assert len(got) == 41 * 41
    for (a, b), r in got.items():
        if np.isnan(want.loc[a, b]) or "c7" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-8)


def test_correlation_with_missing_and_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 7.0, 5.0), (4.0, 8.0, 5.0)], "a double, b double, k double")
    r = st.correlation_values(df, ["a", "b", "k"])
    assert r["a", "b"] == pytest.approx(np.corrcoef([1, 3, 4], [2, 7, 8])[0, 1])
    assert r["a", "k"] is None and r["k", "k"] is None and r["a", "a"] == 1.0


def test_pca_matches_eigenvalues(points):
    rows = np.array([[r[c] for c in COLS] for r in points.dropna().collect()])
    eigen = np.sort(np.linalg.eigvalsh(np.corrcoef(rows.T)))[::-1] / 3
    fitted = st.fit_pca(points, COLS, 5)
    assert fitted.ratios == pytest.approx(list(eigen), abs=1e-9)
    assert all(fitted.loadings[np.abs(fitted.loadings).argmax(axis=0), range(3)] > 0)
    assert st.fit_pca(points.limit(0), COLS) is None and len(st.fit_pca(points.dropna().limit(5), COLS).ratios) == min(5, len(COLS))


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def test_auc_in_value_buckets(spark, monkeypatch):
    from tablelab.functions import order

    monkeypatch.setattr(order, "ROWS_PER_TASK", 40)
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label int, probability double")
    counts = ev.score_counts(df)
    run = order.running_sums(counts, "score", ["pos", "neg"], rows_per_task=10)
    won = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)) / (F.max("total_pos") * F.max("total_neg"))
    assert run.agg(won.alias("a")).first()["a"] == pytest.approx(brute_auc(y, p))
    assert ev.roc_auc(df).first()["roc_auc"] == pytest.approx(brute_auc(y, p))
    assert ev.roc_auc(df.filter("label = 1")).first()["roc_auc"] is None


def test_brier_refuses_margins(spark):
    df = spark.createDataFrame([(1, 1.5)], "label int, probability double")
    with pytest.raises(Exception, match="probabilities"):
        ev.brier(df).collect()


def test_calibration_edges(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.1), (1, 0.100001), (1, 1.0)], "label int, probability double")
    assert {r["bin"]: r["n"] for r in ev.calibration(df).collect()} == {0: 2, 1: 1, 9: 1}


def test_hash_draws(spark):
    df = spark.range(20000).select(uniform(["id"], 1).alias("u"), standard_normal(["id"], 1).alias("z"), uniform(["id"], 1, "md5").alias("m"))
    r = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev("z"), F.avg("m")).first()
    assert abs(r[0] - 0.5) < 0.01 and r[1] >= 0 and r[2] < 1 and abs(r[3]) < 0.03 and abs(r[4] - 1) < 0.03 and abs(r[5] - 0.5) < 0.01


def test_split_and_folds(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    parts = mo.split(df, "y", ["id"])
    assert {(r["y"], r["is_test"]): r["count"] for r in parts.groupBy("y", "is_test").count().collect()} == {
        (0, 0): 630, (0, 1): 270, (1, 0): 70, (1, 1): 30,
    }
    sizes = [r["count"] for r in mo.folds(df, "y", ["id"], 5).groupBy("y", "fold").count().collect()]
    assert sorted(sizes) == [20] * 5 + [180] * 5


@pytest.fixture(scope="module")
def learnable(spark):
    return spark.range(1500).select(
        "id", ((F.col("id") * 37) % 101).cast("double").alias("u"), ((F.col("id") * 53) % 97).cast("double").alias("v"),
        ((F.col("id") * 11) % 7).cast("double").alias("w"),
    ).withColumn("y", ((F.col("u") > 50) & (F.col("v") < 40)).cast("int")).cache()


@pytest.fixture(scope="module")
def tree(learnable):
    return mo.train(learnable, ["u", "v", "w"], "y", ["id"], "tree", {"maxDepth": (2, 4), "minInstancesPerNode": (5,)}, k=3)


def test_tree_learns_the_rule(tree):
    assert tree.metrics["roc_auc"] > 0.95 and tree.metrics["f1_macro"] > 0.9
    assert list(tree.importances)[-1] == "w"


def test_every_row_is_in_one_leaf_that_predicts_it(spark, learnable, tree):
    table = mo.rule_table(spark, tree)
    leaves = mo.leaf_rules(spark, table).collect()
    scored = tree.score(learnable)
    inside = [F.when(F.expr(r["predicate"]), F.lit(r["prediction"])) for r in leaves]
    hits = sum((c.isNotNull().cast("int") for c in inside), F.lit(0))
    bad = scored.filter((hits != 1) | (F.coalesce(*inside) != F.col("prediction"))).count()
    assert bad == 0
    assert table.filter("parent IS NULL").count() == 1
    ranges = {r["feature"]: r for r in mo.split_ranges(table).collect()}
    assert set(ranges) <= {"u", "v", "w"} and 45 < ranges["u"]["max_threshold"] < 60


def test_boosted_trees_and_stress(spark, learnable):
    m = mo.train(learnable, ["u", "v", "w"], "y", ["id"], "gbt", {"maxDepth": (3,), "maxIter": (4,)}, k=2)
    assert m.metrics["roc_auc"] > 0.95
    assert mo.rule_table(spark, m).select("tree").distinct().count() == 4
    levels = {r["level"]: r for r in se.perturbation(learnable, ["u", "v", "w"], ["id"], m.score, [0.0, 0.2]).collect()}
    assert levels[0.0]["stability"] == 1.0 and levels[0.2]["stability"] < 1.0
    boot = se.bootstrap_intervals(se.bootstrap_metrics(m.score(learnable), ["id"], 20, label="y"))
    for r in boot.collect():
        assert r["ci_lower"] <= r["mean"] <= r["ci_upper"]


def test_labels_that_cannot_be_trained_are_skipped(learnable):
    df = learnable.withColumn("one", F.lit(0)).withColumn("few", (F.col("id") < 3).cast("int"))
    done, skipped = mo.train_each(df, ["u"], ["one", "few"], ["id"])
    assert not done and set(skipped) == {"one", "few"}


def test_one_hot_categories_reach_the_importances(learnable):
    df = learnable.withColumn("kind", F.when(F.col("y") == 1, "p").otherwise("q"))
    m = mo.train(df, ["w"], "y", ["id"], "tree", {"maxDepth": (2,)}, k=2, categorical=["kind"])
    assert m.metrics["f1_macro"] == 1.0 and list(m.importances)[0].startswith("kind")


def test_splits_by_category_are_rules_over_categories(spark, learnable):
    df = learnable.withColumn("kind", F.when(F.col("y") == 1, "p").otherwise("q"))
    m = mo.train(df, ["w"], "y", ["id"], "tree", {"maxDepth": (2,)}, k=2, categorical=["kind"])
    rules = mo.rule_table(spark, m)
    assert rules.filter("categories is not null and threshold is null and feature like 'kind%'").count() >= 1
    assert mo.split_ranges(rules).filter("feature like 'kind%'").count() == 0
    slots = [n for n in m.vector_names if n.startswith("kind")]
    encoded = m.score(df)
    values = m.prepare.transform(df).select("id", F.posexplode(vector_to_array("features")).alias("at", "v"))
    wide = values.groupBy("id").pivot("at").agg(F.first("v")).toDF("id", *m.vector_names).join(encoded.select("id", "prediction"), "id")
    for r in mo.leaf_rules(spark, rules).collect():
        assert wide.filter(r["predicate"]).filter(F.col("prediction") != r["prediction"]).count() == 0
    assert slots


def test_bootstrap_in_blocks_is_one_block(spark):
    """Blocks of scores, rows that stand together as counts, and rows one by one give the same figures."""
    rows = spark.range(3000).select(
        "id", (F.col("id") % 7 % 2).cast("int").alias("label"),
        F.when(F.col("id") % 3 == 0, 0.5).when(F.col("id") % 100 == 1, None).otherwise((F.col("id") * 13 % 97) / 97.0).alias("probability"),
        (F.col("id") % 5 % 2).cast("int").alias("prediction"),
    )
    figures = lambda **more: {r["replicate"]: tuple(r) for r in se.bootstrap_metrics(rows, ["id"], 12, **more).collect()}
    one = figures()
    assert len(one) == 12 and figures(rows_per_task=200) == {k: pytest.approx(v, nan_ok=True) for k, v in one.items()}
    drawn = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("replicate"))
    drawn = drawn.filter(uniform(["id"], F.col("replicate") + F.lit(42)) < math.exp(-1)).fillna(-1.0, ["probability"])
    plain = {r["replicate"]: r for r in ev.metrics(drawn, by=["replicate"]).join(ev.roc_auc(drawn, by=["replicate"]), "replicate").collect()}
    for k, found in one.items():
        want = plain[k]
        assert found[2:] == pytest.approx((want["accuracy"], want["f1_macro"], want["precision"], want["recall"], want["roc_auc"]))


def test_bootstrap_shuffles_no_row_copies(spark):
    rows = spark.range(100).select("id", F.lit(1).alias("label"), F.lit(0.5).alias("probability"), F.lit(1).alias("prediction"))
    plan = se.bootstrap_metrics(rows, ["id"], 10)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


def test_histograms_of_many_groups(spark):
    rows = spark.range(4000).select((F.col("id") % 1500).alias("g"), (F.col("id") * 0.1).alias("x"))
    table = pr.histograms(rows, ["x"], 4, ["g"])
    assert table.count() == 6000 and table.agg(F.sum("n")).first()[0] == 4000
    alone = pr.histograms(rows.filter("g = 7").drop("g"), ["x"], 4).orderBy("bin").collect()
    assert [tuple(r) for r in table.filter("g = 7").orderBy("bin").drop("g").collect()] == [tuple(r) for r in alone]


def test_ranks_in_buckets_are_those_of_one(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, (F.col("id") % 2)).alias("y"))
    one = {r["id"]: (r["_rank"], r["_size"]) for r in stratified_rank(rows, "y", ["id"]).collect()}
    many = {r["id"]: (r["_rank"], r["_size"]) for r in stratified_rank(rows, "y", ["id"], rows_per_task=50).collect()}
    assert one == many and len(one) == 2000
