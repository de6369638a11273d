"""Queries of model training, what the models learned, and refit-based stress tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.groups import by_label
from ..operators import evaluate as ev
from ..operators import models as mo
from ..operators import sensitivity as se
from ..operators import stats as st
from ..operators import trees as tr
from .base import query, sql, view
from .evaluating import _BOOT, _NOISE, _grid, _logit, _sweep, formula_scorer, md5_hash
from .profiling import _union

S, X, L = "scored", "scored_features", "line_features"
FEATURES = ["qty", "price", "disc", "tax"]
# The id of an order line repeats, so the key takes every column.
KEYS = ["id", "qty", "price", "disc", "tax"]

_RANKED = f"""h AS (SELECT *, {md5_hash('id', '42')} AS h FROM {S}),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, id) - 1 AS rank, count(*) OVER (PARTITION BY label) AS n FROM h)"""


@query("p8_features", sql(f"SELECT id, qty, price FROM {L}", L, doubles="qty price"))
def _(s, d):
    df = view(s, d, L)
    here, _ = mo.feature_columns(df, ["qty", "absent", "price"])
    return df.select("id", *here)


@query("t1_split", sql("SELECT id, label, CAST(rank < 0.3 * (n - 1) AS INTEGER) AS is_test FROM k", S, ctes=_RANKED))
def _(s, d):
    return mo.split(view(s, d, S), "label", ["id"], method="md5").select("id", "label", "is_test")


@query("t2_folds", sql("SELECT id, label, CAST(rank % 5 AS INTEGER) AS fold FROM k", S, ctes=_RANKED))
def _(s, d):
    return mo.folds(view(s, d, S), "label", ["id"], method="md5").select("id", "label", "fold")


@query(
    "t3_weights",
    sql(
        f"""SELECT id, CASE WHEN label = 1 THEN CAST(n0 AS DOUBLE) / n1 ELSE 1 END AS ratio,
        CAST(n0 + n1 AS DOUBLE) / (2 * CASE WHEN label = 1 THEN n1 ELSE n0 END) AS balanced
        FROM {S}, (SELECT count_if(label = 0) n0, count_if(label = 1) n1 FROM {S})""",
        S, doubles="ratio balanced",
    ),
)
def _(s, d):
    df = view(s, d, S)
    return df.select("id", mo.class_weight(df, "label", "ratio").alias("ratio"), mo.class_weight(df, "label", "balanced").alias("balanced"))


#: The library's own grids; every row is fitted.
GRIDS = {"gbt": mo.GBT_GRID, "tree": mo.TREE_GRID}

_FITTED: dict[tuple, mo.Trained] = {}


def trained(s, d, learner: str, label: str = "bulk") -> mo.Trained:
    """One fit per session, table folder, learner and label, shared by the queries that look into it."""
    key = (s.sparkContext.applicationId, d, learner, label)
    if key not in _FITTED:
        _FITTED[key] = mo.train(view(s, d, L), FEATURES, label, KEYS, learner, GRIDS[learner])
    return _FITTED[key]


def _constants(*rows: tuple) -> str:
    """SQL of a few constant rows; the names stand in the first."""
    names, *values = rows
    return sql("SELECT * FROM (VALUES " + ", ".join(f"({', '.join(v)})" for v in values) + f") AS v({', '.join(names)})")


# A fitted model has no SQL twin, so these queries check what must hold of it: quality over a floor, and figures
# that are recomputed from the data or from the model's own rules. ``bulk`` follows from quantity and discount.
FLOOR = 0.95


@query("t4_gbt", _constants(("metric", "over_floor"), *[(f"'{m}'", "true") for m in ("accuracy", "f1_macro", "precision", "recall", "roc_auc")]))
def _(s, d):
    m = trained(s, d, "gbt")
    return s.createDataFrame([(k, m.metrics[k] > FLOOR) for k in ("accuracy", "f1_macro", "precision", "recall", "roc_auc")], "metric string, over_floor boolean")


@query("t5_tree", _constants(("metric", "over_floor"), *[(f"'{m}'", "true") for m in ("accuracy", "f1_macro", "precision", "recall", "roc_auc")]))
def _(s, d):
    m = trained(s, d, "tree")
    return s.createDataFrame([(k, m.metrics[k] > FLOOR) for k in ("accuracy", "f1_macro", "precision", "recall", "roc_auc")], "metric string, over_floor boolean")


@query("t6_grid", _constants(("name", "ok"), ("'maxDepth'", "true"), ("'minInstancesPerNode'", "true"), ("'cv_mean'", "true"), ("'cv_std'", "true")))
def _(s, d):
    m = trained(s, d, "tree")
    rows = [(k, v in GRIDS["tree"][k]) for k, v in m.best_params.items()]
    return s.createDataFrame([*rows, ("cv_mean", m.metrics["cv_mean"] > FLOOR), ("cv_std", m.metrics["cv_std"] < 0.05)], "name string, ok boolean")


@query("t7_onehot", sql("SELECT id, CASE lang WHEN l1 THEN 0 WHEN l2 THEN 1 WHEN l3 THEN 2 ELSE 3 END AS category FROM (SELECT doc_id AS id, lang FROM documents), (SELECT q[1] l1, q[2] l2, q[3] l3 FROM (SELECT list(lang ORDER BY n DESC, lang) AS q FROM (SELECT lang, count(*) n FROM documents GROUP BY lang)))"))
def _(s, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    df = view(s, d, "label_docs").select("id", "lang")
    out = Pipeline(stages=mo.one_hot(["lang"])).fit(df).transform(df)
    hot = F.array_position(vector_to_array("lang_onehot"), F.lit(1.0)).cast("int")
    return out.select("id", (hot - 1).alias("category"))


# ``returned`` has nothing to do with the features, so a model of it is no better than a guess.
@query("t8_label_models", _constants(("label", "over_floor", "a_guess"), ("'bulk'", "true", "false"), ("'returned'", "false", "true")))
def _(s, d):
    table = mo.compare(s, {n: trained(s, d, "tree", n) for n in ("bulk", "returned")})
    return table.select("label", (F.col("f1_macro") > FLOOR).alias("over_floor"), (F.abs(F.col("roc_auc") - 0.5) < 0.1).alias("a_guess"))


@query("t9_importance", _constants(("total", "top_two"), ("1.0::DOUBLE", "'disc,qty'")))
def _(s, d):
    table = mo.importance_table(s, trained(s, d, "gbt"))
    first = F.array_join(F.array_sort(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(-F.col("importance"), "feature"))), 1, 2), lambda x: x["feature"])), ",")
    return table.agg(F.round(F.sum("importance"), 9).alias("total"), first.alias("top_two"))


@query("t10_split_counts", _constants(("wrong",), ("0::BIGINT",)))
def _(s, d):
    rules = mo.rule_table(s, trained(s, d, "gbt"))
    inner = rules.filter(F.col("left").isNotNull()).groupBy(F.col("feature").alias("f")).agg(F.count("*").alias("n"))
    both = mo.split_importance(rules).join(inner, F.col("feature") == F.col("f"), "full")
    return both.agg(F.count_if(~F.col("splits").eqNullSafe(F.col("n")) | (F.col("gain") < 0)).alias("wrong"))


@query("t11_rules", _constants(("wrong",), ("0::BIGINT",)))
def _(s, d):
    # The rows of a node are those of its children.
    rules = mo.rule_table(s, trained(s, d, "gbt"))
    below = rules.groupBy("tree", F.col("parent").alias("node")).agg(F.sum("count").alias("below"))
    both = rules.filter(F.col("left").isNotNull()).join(below, ["tree", "node"], "left")
    return both.agg(F.count_if(~F.col("below").eqNullSafe(F.col("count"))).alias("wrong"))


@query("t11_leaf_rules", sql(f"SELECT count(*) AS covered, 0::BIGINT AS wrong FROM {L}", L))
def _(s, d):
    m = trained(s, d, "tree")
    rules = mo.leaf_rules(s, mo.rule_table(s, m)).collect()  # model size
    rows = m.score(view(s, d, L))
    hits = reduce(lambda a, b: a + b, [F.expr(r["predicate"]).cast("int") for r in rules])
    wrong = reduce(lambda a, b: a | b, [F.expr(r["predicate"]) & (F.col("prediction") != r["prediction"]) for r in rules])
    return rows.agg(F.sum(hits).alias("covered"), F.count_if(wrong).alias("wrong"))


@query("t11_tree_leaves", sql(f"SELECT count(*) AS rows, 0::BIGINT AS wrong FROM {L}", L))
def _(s, d):
    # The leaves that a row reaches in all trees of the boosted model add up to its probability.
    m = trained(s, d, "gbt")
    ready = m.prepare.transform(view(s, d, L)).withColumn("_row", F.struct(*KEYS))
    margins = tr.tree_leaves(ready, tr.Forest.of(s, m.model), ["_row"]).groupBy("_row").agg(F.sum("value").alias("margin"), F.count_if(F.col("tree") == 0).alias("times"))
    scored = m.score(view(s, d, L)).select(F.struct(*KEYS).alias("_row"), "probability").distinct()
    p = 1.0 / (1.0 + F.exp(-2.0 * F.col("margin") / F.col("times")))
    both = margins.join(scored, "_row")
    return both.agg(F.sum("times").alias("rows"), F.count_if(F.abs(p - F.col("probability")) > 1e-9).alias("wrong"))


@query("t12_thresholds", _constants(("outside",), ("0::BIGINT",)))
def _(s, d):
    ranges = mo.split_ranges(mo.rule_table(s, trained(s, d, "tree")))
    values = view(s, d, L).agg(*[F.struct(F.lit(c).alias("feature"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c in FEATURES])
    values = values.select(F.inline(F.array(*FEATURES)))
    return ranges.join(values, "feature").agg(F.count_if((F.col("min_threshold") < F.col("low")) | (F.col("max_threshold") > F.col("high"))).alias("outside"))


@query(
    "t13_ranges",
    sql(_union(f"SELECT '{c}' AS feature, min({c}) AS min, max({c}) AS max, avg({c}) AS mean, stddev_samp({c}) AS std FROM {L}" for c in ("disc", "qty")), L, doubles="min max mean std"),
)
def _(s, d):
    rules = mo.rule_table(s, trained(s, d, "tree"))
    return mo.used_value_ranges(view(s, d, L), rules.filter(F.col("feature").isin("disc", "qty")))


@query("t14_compare", _constants(("label", "over_floor"), ("'boosted'", "true"), ("'single'", "true")))
def _(s, d):
    table = mo.compare(s, {"boosted": trained(s, d, "gbt"), "single": trained(s, d, "tree")})
    return table.select("label", (F.col("f1_macro") > FLOOR).alias("over_floor"))


@query(
    "e17_scored_points",
    sql(
        f"""SELECT id, 0 AS wrong, qty, price, CASE WHEN r > 0 THEN (zq + zp) / sqrt(2) ELSE (zq - zp) / sqrt(2) END AS pc1
        FROM (SELECT *, (qty - mq) / vq AS zq, (price - mp) / vp AS zp FROM {L},
        (SELECT avg(qty) mq, stddev_pop(qty) vq, avg(price) mp, stddev_pop(price) vp, corr(qty, price) r FROM {L}))""",
        L, doubles="qty price pc1",
    ),
)
def _(s, d):
    # The outcome of each row against its label and the prediction of the one leaf whose predicate holds.
    df = view(s, d, L)
    m = trained(s, d, "tree")
    points = st.fit_pca(df, ["qty", "price"], 2).project(m.score(df), 2)
    rules = mo.leaf_rules(s, mo.rule_table(s, m)).collect()  # model size
    said = F.coalesce(*[F.when(F.expr(r["predicate"]), F.lit(int(r["prediction"]))) for r in rules])
    y = F.col("bulk")
    expected = F.concat(F.when(y == said, "T").otherwise("F"), F.when(said == 1, "P").otherwise("N"))
    out = points.select("id", "qty", "price", "pc1", ev.outcome("bulk", "prediction").alias("outcome"), expected.alias("expected"))
    return out.select("id", (~F.col("outcome").eqNullSafe(F.col("expected"))).cast("int").alias("wrong"), "qty", "price", "pc1")


@query("n2_perturb_model", _constants(("undisturbed", "falling"), ("1.0::DOUBLE", "true")))
def _(s, d):
    table = se.perturbation(view(s, d, L), FEATURES, KEYS, trained(s, d, "gbt").score, [0.0, *se.NOISE_LEVELS])
    low, high = F.max_by("stability", "level"), F.min_by("stability", "level")
    return table.agg(F.max(F.when(F.col("level") == 0, F.col("stability"))).alias("undisturbed"), (low < high).alias("falling"))


@query("n3_ablation", _constants(("left_out", "matters"), ("'disc'", "true"), ("'price'", "false"), ("'qty'", "true"), ("'tax'", "false")))
def _(s, d):
    table = se.ablation(view(s, d, L), FEATURES, "bulk", KEYS)
    return table.filter(F.col("left_out").isin(*FEATURES)).select("left_out", (F.abs("impact") > 0.02).alias("matters"))


@query("n5_cv", _constants(("metric", "over_floor"), *[(f"'{m}'", "true") for m in ("accuracy", "f1_macro", "precision", "recall")]))
def _(s, d):
    table = se.repeated_cv(view(s, d, L), FEATURES, "bulk", KEYS)
    return table.select("metric", (F.col("min") > 0.9).alias("over_floor"))


def _stack(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("label"), "*") for n, t in parts.items()])


def _summary_of(name: str, label: str) -> str:
    """SQL of one label's row: the twins of the five analyses over the formula's scores, side by side."""
    own = f"scored AS (SELECT id, {label} AS label, p0 AS probability, CAST(p0 >= 0.5 AS INTEGER) AS prediction FROM base)"
    folds = """c AS (SELECT rank % 5 AS fold, count_if(label = 0 AND prediction = 0) AS tn, count_if(label = 0 AND prediction = 1) AS fp,
    count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 1 AND prediction = 1) AS tp FROM k GROUP BY 1)"""
    return f"""SELECT '{name}' AS label, st.*, co.*, cv.*, bo.*, ro.* FROM
    (SELECT max(stability) FILTER (level = 0.01) AS stability_1pct, max(stability) FILTER (level = 0.05) AS stability_5pct,
     max(stability) FILTER (level = 0.1) AS stability_10pct, max(stability) FILTER (level = 0.2) AS stability_20pct, avg(stability) AS overall_stability,
     CASE WHEN avg(stability) >= 0.9 THEN 'high' WHEN avg(stability) >= 0.7 THEN 'medium' ELSE 'low' END AS grade FROM levels) st,
    (SELECT (sum(a) * sum(a) + sum(b) * sum(b) - count_if(l > 0)) / (count(*) * (count(*) - 1.0::DOUBLE)) AS cohesion FROM
     (SELECT CASE WHEN l > 0 THEN zc / l ELSE 0 END AS a, CASE WHEN l > 0 THEN zb / l ELSE 0 END AS b, l FROM
      (SELECT *, sqrt(zc * zc + zb * zb) AS l FROM unit WHERE name = '{name}'))) co,
    (WITH {own}, {_RANKED}, {folds} SELECT CASE WHEN avg(f) > 0 THEN stddev_pop(f) / avg(f) ELSE 0 END AS cv_coefficient FROM
     (SELECT (coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS f FROM c)) cv,
    (WITH {own}, {_BOOT} SELECT quantile_cont(f1_macro, 0.025) AS f1_ci_lower, quantile_cont(f1_macro, 0.975) AS f1_ci_upper,
     coalesce((1 - avg(f1_macro)) / nullif(stddev_pop(f1_macro), 0), 0) AS z_f1, coalesce((1 - avg(accuracy)) / nullif(stddev_pop(accuracy), 0), 0) AS z_accuracy,
     count(f1_macro) AS n_replicates FROM boot) bo,
    (WITH {own}, {_sweep(_grid(se.ROBUSTNESS))} SELECT (SELECT threshold FROM w ORDER BY f1 DESC, threshold LIMIT 1) AS optimal_threshold,
     max(threshold) FILTER (f1 >= 0.95::DOUBLE * (SELECT max(f1) FROM w)) - min(threshold) FILTER (f1 >= 0.95::DOUBLE * (SELECT max(f1) FROM w)) AS robust_width FROM w) ro"""


_SUMMARY_BASE = f"""base AS (SELECT id, label AS quality, flag2 AS toxic, n_chars, bucket, {_logit('n_chars', 'bucket')} AS p0 FROM {X}),
members AS (SELECT 'quality' AS name, n_chars, bucket FROM base WHERE quality = 1 UNION ALL SELECT 'toxic', n_chars, bucket FROM base WHERE toxic = 1),
unit AS (SELECT name, (n_chars - mc) / coalesce(nullif(sc, 0), 1) AS zc, (bucket - mb) / coalesce(nullif(sb, 0), 1) AS zb FROM members,
(SELECT avg(n_chars) mc, stddev_pop(n_chars) sc, avg(bucket) mb, stddev_pop(bucket) sb FROM members)),
{_NOISE}"""


@query(
    "n7_summary",
    sql(
        _union(_summary_of(n, n) for n in ("quality", "toxic")), X, ctes=_SUMMARY_BASE,
        doubles="stability_1pct stability_5pct stability_10pct stability_20pct overall_stability cohesion cv_coefficient f1_ci_lower f1_ci_upper z_f1 z_accuracy optimal_threshold robust_width",
    ),
)
def _(s, d):
    df = view(s, d, X).withColumnRenamed("label", "quality")
    labels = {"quality": "quality", "toxic": "flag2"}
    scored = {n: formula_scorer(df).withColumn("y", F.col(c)) for n, c in labels.items()}
    stability = _stack({n: se.perturbation(df, ["n_chars", "bucket"], ["id"], formula_scorer, method="md5") for n in labels})
    similarity = st.cosine_similarity(
        by_label(df, list(labels.values()), name="label"), "label", ["n_chars", "bucket"]
    ).replace({"flag2": "toxic"}, subset=["label"])
    folded = {n: mo.folds(t, "y", ["id"], method="md5") for n, t in scored.items()}
    cv = _stack({n: se.cv_summary(ev.metrics(t, by=["fold"], label="y")) for n, t in folded.items()})
    intervals = _stack({n: se.bootstrap_intervals(se.bootstrap_metrics(t, ["id"], label="y", method="md5")) for n, t in scored.items()})
    robust = _stack({n: se.threshold_robustness(t, label="y") for n, t in scored.items()})
    return se.sensitivity_summary(stability, similarity, cv, intervals, robust)


@query(
    "n5_fold_metrics",
    sql(
        "SELECT * FROM ("
        + _union(
            f"SELECT '{m}' AS metric, avg({m}) AS mean, stddev_pop({m}) AS std, CASE WHEN avg({m}) > 0 THEN stddev_pop({m}) / avg({m}) ELSE 0 END AS cv_coefficient, min({m}) AS min, max({m}) AS max, max({m}) - min({m}) AS range FROM g"
            for m in ("accuracy", "f1_macro", "precision", "recall")
        )
        + ")",
        S,
        ctes=_RANKED
        + """, c AS (SELECT rank % 5 AS fold, count_if(label = 0 AND prediction = 0) AS tn, count_if(label = 0 AND prediction = 1) AS fp,
        count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 1 AND prediction = 1) AS tp FROM k GROUP BY 1),
        g AS (SELECT CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
        coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
        (coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS f1_macro FROM c)""",
        doubles="mean std cv_coefficient min max range",
    ),
)
def _(s, d):
    folded = mo.folds(view(s, d, S), "label", ["id"], method="md5")
    return se.cv_summary(ev.metrics(folded, by=["fold"]))
