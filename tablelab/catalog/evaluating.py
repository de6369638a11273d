"""Queries over scored tables, rules and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import rules as ru
from ..operators import sensitivity as se
from .base import query, sql, view
from .profiling import _union

S, X, R, L = "scored", "scored_features", "rule_truth", "line_features"

_C = f"""c AS (SELECT count_if(label = 0 AND prediction = 0)::BIGINT AS tn, count_if(label = 0 AND prediction = 1)::BIGINT AS fp,
count_if(label = 1 AND prediction = 0)::BIGINT AS fn, count_if(label = 1 AND prediction = 1)::BIGINT AS tp FROM {S})"""


def _div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"


def _null_div(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif({b}, 0)"


F1_1, F1_0 = _div("2 * tp", "2 * tp + fp + fn"), _div("2 * tn", "2 * tn + fn + fp")
MACRO = f"({F1_1} + {F1_0}) / 2"


@query(
    "e1_confusion",
    sql(
        "SELECT tn, fp, fn, tp, " + ", ".join(f"CAST({k} * 100 AS DOUBLE) / (tn + fp + fn + tp) AS {k}_pct" for k in ("tn", "fp", "fn", "tp")) + " FROM c",
        S, ctes=_C, doubles="tn_pct fp_pct fn_pct tp_pct",
    ),
)
def _(s, d):
    return ev.confusion(view(s, d, S))


@query(
    "e2_metrics",
    sql(
        f"SELECT {_div('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall, {MACRO} AS f1_macro FROM c",
        S, ctes=_C, doubles="accuracy precision recall f1_macro",
    ),
)
def _(s, d):
    return ev.metrics(view(s, d, S))


@query(
    "e3_class_report",
    sql(
        f"""SELECT ({F1_0} * (tn + fp) + {F1_1} * (tp + fn)) / (tn + fp + fn + tp) AS f1_weighted, {_div('tn', 'tn + fn')} AS precision_0,
        {_div('tn', 'tn + fp')} AS recall_0, {F1_0} AS f1_0, tn + fp AS support_0, {_div('tp', 'tp + fp')} AS precision_1,
        {_div('tp', 'tp + fn')} AS recall_1, {F1_1} AS f1_1, tp + fn AS support_1 FROM c""",
        S, ctes=_C, doubles="f1_weighted precision_0 recall_0 f1_0 precision_1 recall_1 f1_1",
    ),
)
def _(s, d):
    return ev.class_report(view(s, d, S))


def _auc(source: str, where: str = "true") -> str:
    return f"""SELECT sum(CASE WHEN p.probability > n.probability THEN 1.0::DOUBLE WHEN p.probability = n.probability THEN 0.5::DOUBLE ELSE 0 END) / count(*)
    FROM (SELECT * FROM {source} WHERE label = 1 AND {where}) p, (SELECT * FROM {source} WHERE label = 0 AND {where}) n"""


@query("e4_roc_auc", sql(f"SELECT ({_auc(S)}) AS roc_auc", S, doubles="roc_auc"))
def _(s, d):
    return ev.roc_auc(view(s, d, S))


_MULTI = f"""multi AS (SELECT id, CAST(id % 3 AS INTEGER) AS y, [(id * 7) % 10, (id * 3) % 7 + 1, (id * 5) % 11] AS w FROM {S}),
probs AS (SELECT id, y, list_transform(w, lambda x: CAST(x AS DOUBLE) / list_sum(w)) AS p FROM multi)"""


def _probabilities(s, d):
    df = view(s, d, S)
    w = F.array((F.col("id") * 7) % 10, (F.col("id") * 3) % 7 + 1, (F.col("id") * 5) % 11)
    df = df.select("id", (F.col("id") % 3).cast("int").alias("y"), w.alias("w"))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("p", F.transform("w", lambda x: x.cast("double") / total))


@query(
    "e4_roc_auc_multiclass",
    sql(
        "SELECT avg(a) AS roc_auc_macro FROM ("
        + _union(
            f"""SELECT sum(CASE WHEN u.p[{k + 1}] > v.p[{k + 1}] THEN 1.0::DOUBLE WHEN u.p[{k + 1}] = v.p[{k + 1}] THEN 0.5::DOUBLE ELSE 0 END) / count(*) AS a
            FROM (SELECT * FROM probs WHERE y = {k}) u, (SELECT * FROM probs WHERE y <> {k}) v"""
            for k in range(3)
        )
        + ")",
        S, ctes=_MULTI, doubles="roc_auc_macro",
    ),
)
def _(s, d):
    return ev.roc_auc_multiclass(_probabilities(s, d), "y", "p")


_RUN = f"""g AS (SELECT probability AS t, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM {S} GROUP BY 1),
r AS (SELECT t, pos, sum(pos) OVER (ORDER BY t DESC) AS cp, sum(neg) OVER (ORDER BY t DESC) AS cn,
sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)"""


@query(
    "e5_average_precision",
    sql("SELECT sum(CAST(pos AS DOUBLE) / p * CAST(cp AS DOUBLE) / (cp + cn)) AS average_precision FROM r", S, ctes=_RUN, doubles="average_precision"),
)
def _(s, d):
    return ev.average_precision(view(s, d, S))


@query(
    "e6_roc_points",
    sql("SELECT t AS threshold, CAST(cn AS DOUBLE) / n AS fpr, CAST(cp AS DOUBLE) / p AS tpr FROM r", S, ctes=_RUN, doubles="threshold fpr tpr"),
)
def _(s, d):
    return ev.roc_points(view(s, d, S))


@query(
    "e7_rates",
    sql(
        f"SELECT {_div('tn * 100', 'tn + fp')} AS tnr_pct, {_div('tp * 100', 'tp + fn')} AS tpr_pct, {_div('fp * 100', 'tn + fp')} AS fpr_pct, {_div('fn * 100', 'tp + fn')} AS fnr_pct FROM c",
        S, ctes=_C, doubles="tnr_pct tpr_pct fpr_pct fnr_pct",
    ),
)
def _(s, d):
    return ev.rates(view(s, d, S))


def _sweep(grid: str) -> str:
    """CTEs: t (thresholds) and w (counts and metrics per threshold)."""
    return f"""t AS (SELECT unnest({grid}) AS threshold),
    k AS (SELECT threshold, count_if(label = 1 AND probability >= threshold)::BIGINT AS tp, count_if(label = 0 AND probability >= threshold)::BIGINT AS fp,
    count_if(label = 1 AND probability < threshold)::BIGINT AS fn, count_if(label = 0 AND probability < threshold)::BIGINT AS tn FROM {S}, t GROUP BY threshold),
    w AS (SELECT threshold, tp, fp, fn, tn, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall, {F1_1} AS f1,
    {_div('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_div('fp', 'fp + tn')} AS fpr, {_div('tn', 'fp + tn')} AS tnr FROM k)"""


def _grid(values) -> str:
    return "[" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in values) + "]"


SWEEP_COLUMNS = "threshold precision recall f1 accuracy fpr tnr"


@query("e8_sweep", sql("SELECT * FROM w", S, ctes=_sweep(_grid(ev.SWEEP)), doubles=SWEEP_COLUMNS))
def _(s, d):
    return ev.threshold_sweep(view(s, d, S))


@query(
    "e9_sweep_summary",
    sql(
        """SELECT (SELECT threshold FROM w ORDER BY f1 DESC, threshold LIMIT 1) AS best_f1_threshold, (SELECT max(f1) FROM w) AS best_f1,
        (SELECT min(threshold) FROM w WHERE fpr < 0.1) AS low_fpr_threshold,
        (SELECT threshold FROM w ORDER BY abs(threshold - 0.5::DOUBLE), threshold LIMIT 1) AS nearest_half,
        (SELECT f1 FROM w ORDER BY abs(threshold - 0.5::DOUBLE), threshold LIMIT 1) AS f1_at_half""",
        S, ctes=_sweep(_grid(ev.SWEEP)), doubles="best_f1_threshold best_f1 low_fpr_threshold nearest_half f1_at_half",
    ),
)
def _(s, d):
    return ev.sweep_summary(ev.threshold_sweep(view(s, d, S)))


@query(
    "e10_fixed_thresholds",
    sql("SELECT * FROM w", S, ctes=_sweep(_grid(ev.FIXED_THRESHOLDS)), doubles=SWEEP_COLUMNS),
)
def _(s, d):
    return ev.threshold_sweep(view(s, d, S), ev.FIXED_THRESHOLDS)


@query(
    "e10_best_threshold",
    sql(
        "SELECT coalesce((SELECT threshold FROM w WHERE f1 > 0 ORDER BY f1 DESC, threshold LIMIT 1), 0.5)::DOUBLE AS threshold, (SELECT max(f1) FROM w) AS f1",
        S, ctes=_sweep(_grid(ev.FIXED_THRESHOLDS)), doubles="threshold f1",
    ),
)
def _(s, d):
    return ev.best_threshold(ev.threshold_sweep(view(s, d, S), ev.FIXED_THRESHOLDS))


@query(
    "e11_calibration",
    sql(
        f"""SELECT CAST(greatest(0, ceil(round(probability * 10, 9)) - 1) AS INTEGER) AS bin, avg(probability) AS mean_probability,
        avg(label) AS fraction_positive, count(*) AS n FROM {S} GROUP BY 1""",
        S, doubles="mean_probability fraction_positive",
    ),
)
def _(s, d):
    return ev.calibration(view(s, d, S))


@query(
    "e12_brier",
    sql(
        f"SELECT avg((probability - label) * (probability - label)) AS brier, avg(label) * (1 - avg(label)) AS brier_base_rate FROM {S}",
        S, doubles="brier brier_base_rate",
    ),
)
def _(s, d):
    return ev.brier(view(s, d, S))


@query(
    "e13_brier_multiclass",
    sql(
        "SELECT avg(" + " + ".join(f"pow(p[{k + 1}] - CASE WHEN y = {k} THEN 1 ELSE 0 END, 2)" for k in range(3)) + ") AS brier_multiclass FROM probs",
        S, ctes=_MULTI, doubles="brier_multiclass",
    ),
)
def _(s, d):
    return ev.brier_multiclass(_probabilities(s, d), "y", "p")


@query("e14_base_rate", sql(f"SELECT flag2 * 1 AS flag2, avg(label) * (1 - avg(label)) AS brier_base_rate FROM {S} GROUP BY flag2", S, doubles="brier_base_rate"))
def _(s, d):
    return ev.brier(view(s, d, S), by=["flag2"]).select("flag2", "brier_base_rate")


def _fp_row(c: str) -> str:
    fp, tn = "label = 0 AND prediction = 1", "label = 0 AND prediction = 0"
    return f"""SELECT '{c}' AS feature, avg({c}) FILTER ({fp}) AS fp_mean, stddev_samp({c}) FILTER ({fp}) AS fp_std,
    avg({c}) FILTER ({tn}) AS tn_mean, stddev_samp({c}) FILTER ({tn}) AS tn_std,
    avg({c}) FILTER ({fp}) - avg({c}) FILTER ({tn}) AS difference,
    CAST(count_if({fp}) * 100 AS DOUBLE) / count_if(label = 0) AS fp_rate_pct FROM {X} HAVING count_if({fp}) > 0"""


@query(
    "e15_fp_features",
    sql(f"SELECT *, row_number() OVER (ORDER BY abs(difference) DESC, feature)::INTEGER AS rank FROM ({_union(map(_fp_row, ('n_chars', 'bucket')))})", X, doubles="fp_mean fp_std tn_mean tn_std difference fp_rate_pct"),
)
def _(s, d):
    return ev.false_positive_features(view(s, d, X), ["n_chars", "bucket"])


@query(
    "e16_fp_attribution",
    sql(
        "SELECT *, row_number() OVER (ORDER BY abs(contribution) DESC, feature)::INTEGER AS rank FROM (" + _union(
            f"""SELECT '{c}' AS feature, {w} * coalesce((avg({c}) FILTER (label = 0 AND prediction = 1) - avg({c})) / nullif(stddev_samp({c}), 0), 0) AS contribution
            FROM {X} HAVING count_if(label = 0 AND prediction = 1) > 0"""
            for c, w in (("n_chars", "0.7::DOUBLE"), ("bucket", "0.3::DOUBLE"))
        ) + ")",
        X, doubles="contribution",
    ),
)
def _(s, d):
    return ev.false_positive_attribution(view(s, d, X), {"n_chars": 0.7, "bucket": 0.3})


@query(
    "e17_outcomes",
    sql("SELECT tn, fp, fn, tp, 100 * CAST(tn + tp AS DOUBLE) / (tn + fp + fn + tp) AS pass_pct FROM c", S, ctes=_C, doubles="pass_pct"),
)
def _(s, d):
    return ev.outcome_counts(view(s, d, S))


@query(
    "e17_outcome_rows",
    sql(
        f"""SELECT id, CASE WHEN label = 0 AND prediction = 0 THEN 'TN' WHEN label = 1 AND prediction = 1 THEN 'TP'
        WHEN prediction = 1 THEN 'FP' ELSE 'FN' END AS outcome FROM {S}""",
        S,
    ),
)
def _(s, d):
    return view(s, d, S).select("id", ev.outcome().alias("outcome"))


@query(
    "e18_membership",
    sql(
        f"""SELECT CASE returned + is_open + bulk WHEN 0 THEN 'none' WHEN 1 THEN 'single' ELSE 'overlap' END AS membership,
        returned + is_open + bulk AS subsets, count(*) AS n FROM {L} GROUP BY ALL""",
        L,
    ),
)
def _(s, d):
    return ev.membership_counts(view(s, d, L), ["returned", "is_open", "bulk"])


@query(
    "e19_status",
    sql(
        f"""SELECT count_if(st = -1)::BIGINT AS outside, count_if(st = 0)::BIGINT AS passed, count_if(st = 1)::BIGINT AS failed,
        coalesce(CAST(count_if(st = 0) * 100 AS DOUBLE) / nullif(count_if(st >= 0), 0), 0) AS passed_pct
        FROM (SELECT CASE WHEN label = 0 AND flag2 = 0 THEN -1 WHEN (label = 1 OR flag2 = 1) AND prediction <> 1 THEN 1 ELSE 0 END AS st FROM {S})""",
        S, doubles="passed_pct",
    ),
)
def _(s, d):
    return ev.status_counts(view(s, d, S), [("label", "prediction"), ("flag2", "prediction")])


# --- rules ------------------------------------------------------------------------------------------


def _rules():
    m = F.col("measured")
    return [
        ru.Rule("large", F.col("rule_a"), m > 25, m.isNotNull()),
        ru.Rule("never", F.col("rule_never"), m >= 40, m.isNotNull() & (F.col("origin") == "measured")),
    ]


_RULE_ROWS = f"""rr AS (SELECT 'large' AS class, rule_a AS p, CAST(measured > 25 AS INTEGER) AS t FROM {R} WHERE measured IS NOT NULL
UNION ALL SELECT 'never', rule_never, CAST(measured >= 40 AS INTEGER) FROM {R} WHERE measured IS NOT NULL AND origin = 'measured')"""
_RULE_COUNTS = """count_if(p = 1 AND t = 1)::BIGINT AS tp, count_if(p = 1 AND t = 0)::BIGINT AS fp,
count_if(p = 0 AND t = 1)::BIGINT AS fn, count_if(p = 0 AND t = 0)::BIGINT AS tn"""
_P, _RC, _SP = _null_div("tp", "tp + fp"), _null_div("tp", "tp + fn"), _null_div("tn", "tn + fp")
_FIGURES = f"""tp + fp + fn + tn AS n, tp + fn AS pos_truth, tp + fp AS pos_pred, tp, fp, fn, tn, {_P} AS precision, {_RC} AS recall,
{_SP} AS specificity, {_null_div('tp + tn', 'tp + fp + fn + tn')} AS accuracy,
CASE WHEN tp > 0 THEN 2 * ({_P}) * ({_RC}) / (({_P}) + ({_RC})) END AS f1,
coalesce(({_RC} + {_SP}) / 2, {_RC}, {_SP}) AS balanced_accuracy,
(CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0) AS mcc"""
_FIGURE_DOUBLES = "precision recall specificity accuracy f1 balanced_accuracy mcc"


@query(
    "x12_rule_metrics",
    sql(f"SELECT class, {_FIGURES} FROM (SELECT class, {_RULE_COUNTS} FROM rr GROUP BY class)", R, ctes=_RULE_ROWS, doubles=_FIGURE_DOUBLES),
)
def _(s, d):
    return ru.rule_metrics(view(s, d, R), _rules())


@query(
    "x13_rule_brier",
    sql(
        """SELECT class, count(*) AS n, avg(CAST(p <> t AS INTEGER)) AS brier_rule, avg(CAST(p <> t AS INTEGER)) AS error_rate,
        avg(t) * (1 - avg(t)) AS brier_base_rate FROM rr GROUP BY class""",
        R, ctes=_RULE_ROWS, doubles="brier_rule error_rate brier_base_rate",
    ),
)
def _(s, d):
    return ru.rule_brier(view(s, d, R), _rules())


@query(
    "x14_sensitivity",
    sql(
        f"""SELECT 'large' AS class, threshold, {_FIGURES} FROM (SELECT threshold, {_RULE_COUNTS} FROM
        (SELECT threshold, rule_a AS p, CAST(measured >= threshold AS INTEGER) AS t FROM {R}, (SELECT unnest([10, 25, 40])::DOUBLE AS threshold)
        WHERE measured IS NOT NULL) GROUP BY threshold)""",
        R, doubles="threshold " + _FIGURE_DOUBLES,
    ),
)
def _(s, d):
    return ru.threshold_sensitivity(view(s, d, R), "large", "rule_a", "measured", [10, 25, 40], "ge")


@query(
    "x15_points",
    sql(
        f"""SELECT id, log10(measured) AS log_value, rule_a AS prediction, CAST(measured > 25 AS INTEGER) AS label,
        CASE WHEN measured <= 25 AND rule_a = 0 THEN 'TN' WHEN measured > 25 AND rule_a = 1 THEN 'TP' WHEN rule_a = 1 THEN 'FP' ELSE 'FN' END AS outcome
        FROM {R} WHERE measured > 0""",
        R, doubles="log_value",
    ),
)
def _(s, d):
    return ru.rule_points(view(s, d, R), ["id"], _rules()[0], "measured")


# --- sensitivity on scored tables -------------------------------------------------------------------

_HASH = "CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)"


def md5_hash(*parts: str) -> str:
    """SQL of the 60-bit md5 row hash over the given texts."""
    return _HASH.format(text=" || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts))


_BOOT = f"""drawn AS (SELECT *, rep + 42 AS seed FROM {S}, (SELECT unnest(range(100)) AS rep)),
oob AS (SELECT * FROM drawn WHERE CAST({md5_hash('id', 'seed')} >> 8 AS DOUBLE) / 4503599627370496 < exp(-1)),
counts AS (SELECT rep, count_if(label = 0 AND prediction = 0) AS tn, count_if(label = 0 AND prediction = 1) AS fp,
count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 1 AND prediction = 1) AS tp FROM oob GROUP BY rep),
auc AS (SELECT p.rep, sum(CASE WHEN p.probability > n.probability THEN 1.0::DOUBLE WHEN p.probability = n.probability THEN 0.5::DOUBLE ELSE 0 END) / count(*) AS roc_auc
FROM oob p JOIN oob n ON p.rep = n.rep AND p.label = 1 AND n.label = 0 GROUP BY p.rep),
boot AS (SELECT CAST(c.rep AS INTEGER) AS replicate, tn + fp + fn + tp AS n, {_div('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {MACRO} AS f1_macro, {_div('tp', 'tp + fp')} AS precision,
{_div('tp', 'tp + fn')} AS recall, roc_auc FROM counts c LEFT JOIN auc a ON c.rep = a.rep)"""


def _boot(s, d):
    return se.bootstrap_metrics(view(s, d, S), ["id"], method="md5")


@query("n1_bootstrap", sql("SELECT * FROM boot", S, ctes=_BOOT, doubles="accuracy f1_macro precision recall roc_auc"))
def _(s, d):
    return _boot(s, d)


@query(
    "n1_intervals",
    sql(
        "SELECT * FROM ("
        + _union(
            f"SELECT '{m}' AS metric, avg({m}) AS mean, stddev_pop({m}) AS std, quantile_cont({m}, 0.025) AS ci_lower, quantile_cont({m}, 0.975) AS ci_upper, count({m}) AS n FROM boot"
            for m in se.METRICS
        )
        + ")",
        S, ctes=_BOOT, doubles="mean std ci_lower ci_upper",
    ),
)
def _(s, d):
    return se.bootstrap_intervals(_boot(s, d))


def formula_scorer(df):
    """A fixed logistic score of two columns, standing in for a fitted model."""
    z = (F.col("n_chars") - 2000.0) / 3000.0 + (F.col("bucket") - 8.0) / 10.0
    out = df.drop("probability", "prediction").withColumn("probability", 1.0 / (1.0 + F.exp(-z)))
    return out.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))


_U = "CAST({h} >> 8 AS DOUBLE) / 4503599627370496"


def _normal(feature: str) -> str:
    u1 = _U.format(h=md5_hash("id", f"'{feature}'", "level", "'radius'", "42"))
    u2 = _U.format(h=md5_hash("id", f"'{feature}'", "level", "'angle'", "42"))
    return f"sqrt(-2 * ln(1 - {u1})) * cos(2 * pi() * {u2})"


def _logit(chars: str, bucket: str) -> str:
    return f"1 / (1 + exp(-(({chars} - 2000) / 3000.0::DOUBLE + ({bucket} - 8) / 10.0::DOUBLE)))"


_NOISE = f"""noisy AS (SELECT level, {_logit('n_chars', 'bucket')} AS p0,
{_logit(f"(n_chars + sc * level * {_normal('n_chars')})", f"(bucket + sb * level * {_normal('bucket')})")} AS p1
FROM {X}, (SELECT stddev_samp(n_chars) sc, stddev_samp(bucket) sb FROM {X}), (SELECT unnest([0.01, 0.05, 0.1, 0.2])::DOUBLE AS level)),
levels AS (SELECT level, avg(CAST((p0 >= 0.5) = (p1 >= 0.5) AS INTEGER)) AS stability, avg(abs(p0 - p1)) AS probability_mae,
corr(p0, p1) AS probability_correlation FROM noisy GROUP BY level)"""


def _perturbed(s, d):
    return se.perturbation(view(s, d, X), ["n_chars", "bucket"], ["id"], formula_scorer, method="md5")


@query("n2_perturb", sql("SELECT * FROM levels", X, ctes=_NOISE, doubles="level stability probability_mae probability_correlation"))
def _(s, d):
    return _perturbed(s, d)


@query("n2_overall", sql("SELECT avg(stability) AS overall_stability FROM levels", X, ctes=_NOISE, doubles="overall_stability"))
def _(s, d):
    return se.overall_stability(_perturbed(s, d))


def _boundary_row(w: float) -> str:
    near, right = f"abs(probability - 0.5::DOUBLE) < {w!r}::DOUBLE", "CAST(CAST(probability >= 0.5 AS INTEGER) = label AS INTEGER)"
    both = f"count_if({near}) > 0 AND count_if(NOT {near}) > 0"
    return f"""SELECT {w!r}::DOUBLE AS width, count_if({near})::BIGINT AS n, CAST(count_if({near}) * 100 AS DOUBLE) / count(*) AS percent,
    CASE WHEN {both} THEN avg({right}) FILTER ({near}) END AS accuracy_inside, CASE WHEN {both} THEN avg({right}) FILTER (NOT {near}) END AS accuracy_outside FROM {S}"""


@query(
    "n4_boundary",
    sql(_union(map(_boundary_row, se.BOUNDARY_WIDTHS)), S, doubles="width percent accuracy_inside accuracy_outside"),
)
def _(s, d):
    return se.boundary(view(s, d, S))


@query(
    "n4_uncertainty",
    sql(
        f"""SELECT least(floor(u * 20), 9)::INTEGER AS interval, count(*) AS n, avg(probability) AS mean_probability, min(u) AS min_uncertainty,
        max(u) AS max_uncertainty, median(u) AS median_uncertainty FROM (SELECT probability, abs(probability - 0.5::DOUBLE) AS u FROM {S}) GROUP BY 1""",
        S, doubles="mean_probability min_uncertainty max_uncertainty median_uncertainty",
    ),
)
def _(s, d):
    return se.uncertainty(view(s, d, S))


@query(
    "n6_threshold",
    sql(
        """SELECT (SELECT threshold FROM w ORDER BY f1 DESC, threshold LIMIT 1) AS optimal_threshold, max(f1) AS optimal_f1,
        (SELECT f1 FROM w ORDER BY abs(threshold - 0.5::DOUBLE), threshold LIMIT 1) AS f1_at_half, var_pop(f1) AS f1_variance, stddev_pop(f1) AS f1_std,
        min(threshold) FILTER (f1 >= 0.95::DOUBLE * (SELECT max(f1) FROM w)) AS robust_low, max(threshold) FILTER (f1 >= 0.95::DOUBLE * (SELECT max(f1) FROM w)) AS robust_high,
        max(threshold) FILTER (f1 >= 0.95::DOUBLE * (SELECT max(f1) FROM w)) - min(threshold) FILTER (f1 >= 0.95::DOUBLE * (SELECT max(f1) FROM w)) AS robust_width FROM w""",
        S, ctes=_sweep(_grid(se.ROBUSTNESS)),
        doubles="optimal_threshold optimal_f1 f1_at_half f1_variance f1_std robust_low robust_high robust_width",
    ),
)
def _(s, d):
    return se.threshold_robustness(view(s, d, S))


@query(
    "n8_grade",
    sql(
        "SELECT level, CASE WHEN stability >= 0.9 THEN 'high' WHEN stability >= 0.7 THEN 'medium' ELSE 'low' END AS grade FROM levels",
        X, ctes=_NOISE, doubles="level",
    ),
)
def _(s, d):
    return _perturbed(s, d).select("level", se.stability_grade(F.col("stability")).alias("grade"))
