"""Threshold rules scored against measured values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import as_column, ratio
from .evaluate import confusion_aggs, outcome


@dataclass(frozen=True)
class Rule:
    """A 0/1 rule column, the measured truth it is held against, and the rows that count."""

    name: str
    prediction: Column
    truth: Column
    mask: Column


def rule_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Long (class, prediction, truth): one row per rule whose mask holds."""
    cells = F.array_compact(
        F.array(
            *[
                F.when(
                    r.mask,
                    F.struct(
                        F.lit(r.name).alias("class"),
                        r.prediction.cast("int").alias("prediction"),
                        F.coalesce(r.truth, F.lit(False)).cast("int").alias("truth"),
                    ),
                )
                for r in rules
            ]
        )
    )
    return df.select(F.inline(cells))


def rule_figures() -> dict[str, Column]:
    """Figures over tp, fp, fn, tn; null on zero division. F1 is null if precision or recall is null or 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    return {
        "precision": precision,
        "recall": recall,
        "specificity": specificity,
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "f1": F.when((precision > 0) & (recall > 0), 2 * precision * recall / (precision + recall)),
        "balanced_accuracy": F.coalesce((recall + specificity) / 2, recall, specificity),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }


def figures_of(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and figures from a table that holds tp, fp, fn, tn per group."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        *by,
        (tp + fp + fn + tn).alias("n"),
        (tp + fn).alias("pos_truth"),
        (tp + fp).alias("pos_pred"),
        "tp", "fp", "fn", "tn",
        *[c.alias(k) for k, c in rule_figures().items()],
    )


def rule_metrics(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    counts = rule_rows(df, rules).groupBy("class").agg(*confusion_aggs(F.col("truth"), F.col("prediction")))
    return figures_of(counts, ["class"])


def rule_brier(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Brier of the 0/1 rule (its error rate) beside the constant base rate."""
    wrong = (F.col("prediction") != F.col("truth")).cast("int")
    return (
        rule_rows(df, rules)
        .groupBy("class")
        .agg(F.count("*").alias("n"), F.avg(wrong).alias("error_rate"), F.avg("truth").alias("_p"))
        .select("class", "n", F.col("error_rate").alias("brier_rule"), "error_rate", (F.col("_p") * (1 - F.col("_p"))).alias("brier_base_rate"))
    )


_DIRECTIONS = {"ge": lambda v, t: v >= t, "gt": lambda v, t: v > t, "lt": lambda v, t: v < t}


def threshold_sensitivity(
    df: DataFrame, name: str, prediction: str, measured: str, thresholds: Sequence[float], direction: str, mask: Column | None = None
) -> DataFrame:
    """The rule's figures for several truth thresholds. The threshold list is part of the row projection."""
    compare = _DIRECTIONS[direction]
    rows = df.filter(as_column(measured).isNotNull() if mask is None else mask)
    at = rows.select(
        as_column(prediction).cast("int").alias("prediction"),
        as_column(measured).alias("_v"),
        F.explode(F.lit([float(t) for t in thresholds])).alias("threshold"),
    )
    truth = F.coalesce(compare(F.col("_v"), F.col("threshold")), F.lit(False)).cast("int")
    counts = at.groupBy("threshold").agg(*confusion_aggs(truth, F.col("prediction")))
    return figures_of(counts, ["threshold"]).select(F.lit(name).alias("class"), "*")


def rule_points(df: DataFrame, keep: Sequence[str], rule: Rule, measured: str) -> DataFrame:
    """log10 of the measured value and the outcome of the rule, per row with a value."""
    rows = df.filter(rule.mask & (as_column(measured) > 0))
    t = F.coalesce(rule.truth, F.lit(False)).cast("int")
    return rows.select(
        *keep, F.log10(as_column(measured)).alias("log_value"), rule.prediction.cast("int").alias("prediction"), t.alias("label")
    ).withColumn("outcome", outcome("label", "prediction"))


def property_rules() -> list[Rule]:
    """The five classes over the wide validation table. Column names and truth thresholds."""
    solubility, kow = as_column("WaterSolubility_mgL__value"), as_column("LogKow__value")
    bcf, koc = as_column("BCF_Lkg__value"), as_column("Koc_Lkg__value")
    half_life = F.coalesce(as_column("DT50_soil_d__value"), as_column("DT50_soil_d__typical_value"))
    measured = F.coalesce(as_column("BCF_Lkg__meas_or_est") == "measured", F.lit(False))
    return [
        Rule("Water Soluble", as_column("cls_WaterSoluble"), solubility >= 1000, solubility.isNotNull()),
        Rule("Aquatic Bioavailable", as_column("cls_AquaticBioavail"), (kow > 0.95) & (kow <= 3.05), kow.isNotNull()),
        Rule("Bioconcentration Risk", as_column("cls_BioconcRisk"), bcf >= 2000, bcf.isNotNull() & measured),
        Rule("Persistence", as_column("cls_Persistence"), half_life > 60, half_life.isNotNull()),
        Rule("Soil Mobility", as_column("cls_SoilMobility"), koc < 500, koc.isNotNull()),
    ]
