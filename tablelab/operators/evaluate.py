"""Evaluation of scored tables (label, probability, prediction). No model is needed.

``by`` groups rows of several models or replicates held in one table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
import operator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.groups import to_long
from ..functions.nulls import as_column, ratio, ratio_or_zero
from ..functions.order import bucket_index, running_sums
from .labeling import set_count

LABEL, PROBABILITY, PREDICTION = "label", "probability", "prediction"


def _count(test: Column, n: str | None = None) -> Column:
    """Rows that pass; ``n`` may name the number of rows that a row stands for."""
    return F.count_if(test) if n is None else F.coalesce(F.sum(F.when(test, as_column(n))), F.lit(0))


def confusion_aggs(label: Column, prediction: Column, n: str | None = None) -> list[Column]:
    return [
        _count((label == 0) & (prediction == 0), n).alias("tn"),
        _count((label == 0) & (prediction == 1), n).alias("fp"),
        _count((label == 1) & (prediction == 0), n).alias("fn"),
        _count((label == 1) & (prediction == 1), n).alias("tp"),
    ]


def confusion(df: DataFrame, by: Sequence[str] = (), label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    """tn, fp, fn, tp and their share of all rows in %."""
    counts = df.groupBy(*by).agg(*confusion_aggs(as_column(label), as_column(prediction)))
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return counts.select("*", *[ratio(F.col(c) * 100, n).alias(f"{c}_pct") for c in ("tn", "fp", "fn", "tp")])


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 from counts, 0 on zero division."""
    return ratio_or_zero(2 * tp, 2 * tp + fp + fn)


def metric_columns() -> dict[str, Column]:
    """Accuracy, precision, recall and F1 figures over columns tn, fp, fn, tp; 0 on zero division."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return {
        "accuracy": ratio_or_zero(tp + tn, tp + tn + fp + fn),
        "precision": ratio_or_zero(tp, tp + fp),
        "recall": ratio_or_zero(tp, tp + fn),
        "f1_macro": (_f1(tp, fp, fn) + _f1(tn, fn, fp)) / 2,
    }


def metrics(df: DataFrame, by: Sequence[str] = (), label: str = LABEL, prediction: str = PREDICTION, n: str | None = None) -> DataFrame:
    """``n`` may name the number of rows that a row stands for."""
    counts = df.groupBy(*by).agg(*confusion_aggs(as_column(label), as_column(prediction), n))
    return counts.select(*by, *[c.alias(k) for k, c in metric_columns().items()])


def class_report(df: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    """Weighted F1, and precision, recall, F1, support of both classes."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n0, n1 = tn + fp, tp + fn
    return df.agg(*confusion_aggs(as_column(label), as_column(prediction))).select(
        ratio_or_zero(_f1(tn, fn, fp) * n0 + _f1(tp, fp, fn) * n1, n0 + n1).alias("f1_weighted"),
        ratio_or_zero(tn, tn + fn).alias("precision_0"),
        ratio_or_zero(tn, n0).alias("recall_0"),
        _f1(tn, fn, fp).alias("f1_0"),
        n0.alias("support_0"),
        ratio_or_zero(tp, tp + fp).alias("precision_1"),
        ratio_or_zero(tp, n1).alias("recall_1"),
        _f1(tp, fp, fn).alias("f1_1"),
        n1.alias("support_1"),
    )


def rates(df: DataFrame, by: Sequence[str] = (), label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    """True and false positive and negative rates in %."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return (
        df.groupBy(*by)
        .agg(*confusion_aggs(as_column(label), as_column(prediction)))
        .select(
            *by,
            ratio_or_zero(tn * 100, tn + fp).alias("tnr_pct"),
            ratio_or_zero(tp * 100, tp + fn).alias("tpr_pct"),
            ratio_or_zero(fp * 100, tn + fp).alias("fpr_pct"),
            ratio_or_zero(fn * 100, tp + fn).alias("fnr_pct"),
        )
    )


# --- ranking ----------------------------------------------------------------------------------------


def score_counts(
    df: DataFrame, by: Sequence[str] = (), label: str = LABEL, probability: str = PROBABILITY, n: str | None = None
) -> DataFrame:
    """Positives and negatives per distinct score: what every ranking figure starts from."""
    return (
        df.select(*by, as_column(probability).cast("double").alias("score"), as_column(label).alias("_y"), *([n] if n else []))
        .groupBy(*by, "score")
        .agg(_count(F.col("_y") == 1, n).alias("pos"), _count(F.col("_y") == 0, n).alias("neg"))
    )


def _running_scores(df: DataFrame, by: Sequence[str], label: str, probability: str, descending: bool, n: str | None = None) -> DataFrame:
    scores = df.select(as_column(probability).cast("double").alias("score"))
    counts = score_counts(df, by, label, probability, n)
    return running_sums(counts, "score", ["pos", "neg"], by=by, descending=descending, spread=scores)


def roc_auc(
    df: DataFrame, by: Sequence[str] = (), label: str = LABEL, probability: str = PROBABILITY, n: str | None = None
) -> DataFrame:
    """Exact area with ties counted half; null when only one class is present. ``n`` as in ``metrics``."""
    run = _running_scores(df, by, label, probability, False, n)
    won = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)
    return run.groupBy(*by).agg(
        F.try_divide(
            F.sum(won), F.max("total_pos").cast("double") * F.max("total_neg").cast("double")
        ).alias("roc_auc")
    )


def roc_auc_multiclass(df: DataFrame, label: str, probabilities: str) -> DataFrame:
    """One-vs-rest area, averaged over the classes. ``probabilities`` is an array indexed by the class number."""
    long = df.select(as_column(label).alias("_class"), F.posexplode(as_column(probabilities)).alias("k", PROBABILITY))
    long = long.select("k", PROBABILITY, (F.col("_class") == F.col("k")).cast("int").alias(LABEL))
    return roc_auc(long, by=["k"]).agg(F.avg("roc_auc").alias("roc_auc_macro"))


def average_precision(df: DataFrame, by: Sequence[str] = (), label: str = LABEL, probability: str = PROBABILITY) -> DataFrame:
    """Sum over thresholds of the recall gained times the precision there."""
    run = _running_scores(df, by, label, probability, True)
    step = ratio(F.col("pos"), F.col("total_pos")) * ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    return run.groupBy(*by).agg(F.sum(step).alias("average_precision"))


def roc_points(df: DataFrame, by: Sequence[str] = (), label: str = LABEL, probability: str = PROBABILITY) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, predicting 1 from the threshold upwards."""
    run = _running_scores(df, by, label, probability, True)
    return run.select(
        *by,
        F.col("score").alias("threshold"),
        ratio(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("total_pos")).alias("tpr"),
    )


# --- thresholds -------------------------------------------------------------------------------------

# The threshold grids of the sweep, the fixed table and the robustness check.
SWEEP = tuple(float(t) for t in np.linspace(0.05, 0.95, 50))
FIXED_THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)
ROBUSTNESS = tuple(float(t) for t in np.linspace(0.1, 0.9, 17))


def threshold_sweep(
    df: DataFrame,
    thresholds: Sequence[float] = SWEEP,
    by: Sequence[str] = (),
    label: str = LABEL,
    probability: str = PROBABILITY,
) -> DataFrame:
    """Counts and metrics of predicting 1 where probability >= threshold, per threshold.

    A row is counted once, in the interval between thresholds its score falls in; the counts of all
    thresholds are sums over those few intervals. No row is multiplied.
    """
    grid = sorted(float(t) for t in thresholds)
    cells = (
        df.select(*by, bucket_index(as_column(probability), grid).alias("_k"), as_column(label).alias("_y"))
        .groupBy(*by, "_k")
        .agg(_count(F.col("_y") == 1).alias("pos"), _count(F.col("_y") == 0).alias("neg"))
        .groupBy(*by)
        .agg(F.collect_list(F.struct("_k", "pos", "neg")).alias("cells"))  # at most len(grid) + 1
    )

    def total(name: str, test) -> Column:
        picked = F.filter("cells", test) if test else F.col("cells")
        return F.aggregate(picked, F.lit(0).cast("long"), lambda acc, x: acc + x[name])

    at = cells.select(*by, "cells", F.posexplode(F.lit(grid)).alias("k", "threshold"))
    at = at.select(
        *by,
        "threshold",
        total("pos", lambda x: x["_k"] > F.col("k")).alias("tp"),
        total("neg", lambda x: x["_k"] > F.col("k")).alias("fp"),
        total("pos", lambda x: x["_k"] <= F.col("k")).alias("fn"),
        total("neg", lambda x: x["_k"] <= F.col("k")).alias("tn"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return at.select(
        "*",
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
        ratio_or_zero(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio_or_zero(fp, fp + tn).alias("fpr"),
        ratio_or_zero(tn, fp + tn).alias("tnr"),
    )


def sweep_summary(sweep: DataFrame, by: Sequence[str] = (), fpr_below: float = 0.1) -> DataFrame:
    """Lowest threshold of the highest F1, first threshold with a low false positive rate, row nearest 0.5."""
    t = F.col("threshold")
    near = F.struct(F.abs(t - 0.5), t)
    return sweep.groupBy(*by).agg(
        F.max_by(t, F.struct(F.col("f1"), -t)).alias("best_f1_threshold"),
        F.max("f1").alias("best_f1"),
        F.min(F.when(F.col("fpr") < fpr_below, t)).alias("low_fpr_threshold"),
        F.min_by(t, near).alias("nearest_half"),
        F.min_by("f1", near).alias("f1_at_half"),
    )


def best_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best F1 by strict improvement over 0, else threshold 0.5 with F1 0."""
    t = F.col("threshold")
    return sweep.groupBy(*by).agg(
        F.coalesce(F.max_by(F.when(F.col("f1") > 0, t), F.struct(F.col("f1"), -t)), F.lit(0.5)).alias("threshold"),
        F.max("f1").alias("f1"),
    )


def calibration(
    df: DataFrame, bins: int = 10, by: Sequence[str] = (), label: str = LABEL, probability: str = PROBABILITY
) -> DataFrame:
    """Mean probability and share of positives per uniform bin; a score on an inner edge belongs to the lower bin."""
    edges = [float(e) for e in np.linspace(0.0, 1.0, bins + 1)[1:-1]]
    p = as_column(probability)
    return (
        df.groupBy(*by, bucket_index(p, edges, strict=True).alias("bin"))
        .agg(F.avg(p).alias("mean_probability"), F.avg(as_column(label)).alias("fraction_positive"), F.count("*").alias("n"))
    )


# --- Brier ------------------------------------------------------------------------------------------


def brier(df: DataFrame, by: Sequence[str] = (), label: str = LABEL, probability: str = PROBABILITY) -> DataFrame:
    """Mean (p - y)^2 beside that of the constant base rate. A score outside [0, 1] is an error."""
    p, y = as_column(probability), as_column(label)
    agg = df.groupBy(*by).agg(
        F.avg((p - y) * (p - y)).alias("brier"), F.avg(y).alias("rate"), _count((p < 0) | (p > 1)).alias("bad")
    )
    checked = F.when(F.col("bad") == 0, F.col("brier")).otherwise(
        F.raise_error("scores must be probabilities in [0, 1]").cast("double")
    )
    return agg.select(*by, checked.alias("brier"), (F.col("rate") * (1 - F.col("rate"))).alias("brier_base_rate"))


def brier_multiclass(df: DataFrame, label: str, probabilities: str) -> DataFrame:
    """Mean over rows of the sum over classes of (p_k - 1[y = k])^2, in [0, 2]."""
    y = as_column(label)
    squares = F.transform(
        as_column(probabilities),
        lambda p, k: (p - (y == k).cast("double")) * (p - (y == k).cast("double")),
    )
    return df.agg(F.avg(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)).alias("brier_multiclass"))


# --- errors by feature ------------------------------------------------------------------------------


def _outcome_stats(df: DataFrame, columns: Sequence[str], label: str, prediction: str) -> DataFrame:
    y, p = as_column(label), as_column(prediction)
    fp, tn = (y == 0) & (p == 1), (y == 0) & (p == 0)
    aggs = [_count(fp).alias("n_fp"), _count(tn).alias("n_tn")]
    for i, c in enumerate(columns):
        v = as_column(c).cast("double")
        aggs.append(
            F.struct(
                F.avg(F.when(fp, v)), F.stddev_samp(F.when(fp, v)),
                F.avg(F.when(tn, v)), F.stddev_samp(F.when(tn, v)),
                F.avg(v), F.stddev_samp(v),
            ).alias(f"s{i}")
        )
    per = {}
    for i, c in enumerate(columns):
        names = ("fp_mean", "fp_std", "tn_mean", "tn_std", "mean", "std")
        per[c] = {k: F.col(f"s{i}.col{n}") for n, k in enumerate(names, start=1)}
    return to_long(df.agg(*aggs).filter(F.col("n_fp") > 0), ["n_fp", "n_tn"], per, "feature")


def _rank(value: str) -> Column:
    """Place by size, from 1, among features (a handful of rows); equal sizes by name."""
    return F.row_number().over(Window.orderBy(F.abs(value).desc_nulls_last(), "feature"))


def false_positive_features(
    df: DataFrame, columns: Sequence[str], label: str = LABEL, prediction: str = PREDICTION
) -> DataFrame:
    """Features by the difference of their means between false positives and true negatives; empty without any."""
    s = _outcome_stats(df, columns, label, prediction)
    return (
        s.select(
            "feature", "fp_mean", "fp_std", "tn_mean", "tn_std",
            (F.col("fp_mean") - F.col("tn_mean")).alias("difference"),
            ratio(F.col("n_fp") * 100, F.col("n_fp") + F.col("n_tn")).alias("fp_rate_pct"),
        )
        .withColumn("rank", _rank("difference"))
        .orderBy("rank")
    )


def false_positive_attribution(
    df: DataFrame, importances: dict[str, float], label: str = LABEL, prediction: str = PREDICTION
) -> DataFrame:
    """importance * (mean of the false positives - overall mean) / overall std, strongest first; 0 where std is 0."""
    weight = F.create_map(*[x for c, w in importances.items() for x in (F.lit(c), F.lit(float(w)))])
    shift = ratio_or_zero(F.col("fp_mean") - F.col("mean"), F.col("std"))
    return (
        _outcome_stats(df, list(importances), label, prediction)
        .select("feature", (weight[F.col("feature")] * shift).alias("contribution"))
        .withColumn("rank", _rank("contribution"))
        .orderBy("rank")
    )


# --- row outcomes -----------------------------------------------------------------------------------


def outcome(label: str = LABEL, prediction: str = PREDICTION) -> Column:
    y, p = as_column(label), as_column(prediction)
    return (
        F.when((y == 0) & (p == 0), F.lit("TN")).when((y == 1) & (p == 1), F.lit("TP")).when(p == 1, F.lit("FP")).otherwise("FN")
    )


def outcome_counts(df: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    """Rows per outcome and the share of rows predicted right (%)."""
    y, p = as_column(label), as_column(prediction)
    o = outcome(label, prediction)
    return df.agg(
        *[_count(o == k).alias(k.lower()) for k in ("TN", "FP", "FN", "TP")],
        (F.avg((y == p).cast("int")) * 100).alias("pass_pct"),
    )


def membership(flags: Sequence[str]) -> Column:
    n = set_count(flags)
    return F.when(n == 0, F.lit("none")).when(n == 1, F.lit("single")).otherwise(F.lit("overlap"))


def membership_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    return df.groupBy(membership(flags).alias("membership"), set_count(flags).alias("subsets")).agg(F.count("*").alias("n"))


def combined_status(flags: Sequence[tuple[str, str]]) -> Column:
    """Over (flag, prediction) pairs: -1 in no subset, 1 if an own member is predicted wrong, else 0."""
    wrong = reduce(
        operator.add, [((as_column(f) == 1) & (as_column(p) != 1)).cast("int") for f, p in flags]
    )
    return F.when(set_count([f for f, _ in flags]) == 0, F.lit(-1)).when(wrong > 0, F.lit(1)).otherwise(F.lit(0))


def status_counts(df: DataFrame, flags: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows per status; among members the share whose predictions are all right (%)."""
    s = combined_status(flags)
    return df.agg(
        _count(s == -1).alias("outside"),
        _count(s == 0).alias("passed"),
        _count(s == 1).alias("failed"),
        ratio_or_zero(_count(s == 0) * 100, _count(s >= 0)).alias("passed_pct"),
    )
