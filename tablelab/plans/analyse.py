"""Train -> evaluate -> stress for every label of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import complete_cases
from ..functions.groups import by_label
from ..operators import evaluate, models, sensitivity, stats


@dataclass
class Analysis:
    models: dict[str, models.Trained]
    skipped: dict[str, str]
    tables: dict[str, DataFrame] = field(default_factory=dict)


def _stack(parts: Mapping[str, DataFrame]) -> DataFrame | None:
    labelled = [t.select(F.lit(n).alias("label"), "*") for n, t in parts.items()]
    return reduce(DataFrame.unionByName, labelled) if labelled else None


def analyse(
    df: DataFrame, labels: Sequence[str], features: Sequence[str], keys: Sequence[str], config: Mapping[str, Any] | None = None
) -> Analysis:
    """PCA, similarity, one model per trainable label, evaluation tables and the sensitivity summary."""
    config = config or {}
    settings = config.get("model_settings", {})
    learner = settings.get("learner", "gbt")
    names = (
        {"maxDepth": "max_depth_range", "maxIter": "n_estimators_range", "stepSize": "learning_rate_range"}
        if learner == "gbt"
        else {"maxDepth": "max_depth_range", "minInstancesPerNode": "min_samples_leaf_range"}
    )
    defaults = models.GBT_GRID if learner == "gbt" else models.TREE_GRID
    grid = {p: settings.get(k, defaults[p]) for p, k in names.items()}
    features, _ = models.feature_columns(df, features)
    rows = complete_cases(df, features)
    done, skipped = models.train_each(
        rows,
        features,
        labels,
        keys,
        learner=learner,
        grid=grid,
        k=config.get("cv_folds", 5),
        test_share=config.get("test_size", 0.3),
        seed=config.get("random_seed", 42),
        categorical=[c for c in config.get("categorical_features", []) if c in df.columns],
        metric=settings.get("tuning_metric", "f1_macro"),
    )
    out = Analysis(done, skipped)
    t = out.tables
    fitted = stats.fit_pca(rows, features, config.get("pca_analysis", {}).get("n_components", 5))
    if fitted is not None:
        t["pca_variance"], t["pca_loadings"] = fitted.variance(rows), fitted.loading_table(rows)
        t["pca_points"] = stats.pca_points(rows, fitted, [*keys, *labels])
    t["similarity"] = stats.cosine_similarity(
        by_label(rows, labels, name="_label"), "_label", features, stats.fit_scaling(rows, features)
    )
    if not done:
        return out
    t["comparison"] = models.compare(df.sparkSession, done)
    scored = {n: m.scored_test.withColumnRenamed(n, "y") for n, m in done.items()}
    per = lambda f: _stack({n: f(s) for n, s in scored.items()})
    t["confusion"] = per(lambda s: evaluate.confusion(s, label="y"))
    t["sweep"] = per(lambda s: evaluate.threshold_sweep(s, label="y"))
    t["calibration"] = per(lambda s: evaluate.calibration(s, label="y"))
    t["sweep_summary"] = evaluate.sweep_summary(t["sweep"], by=["label"])
    t["class_report"] = per(lambda s: evaluate.class_report(s, label="y"))
    t["roc_points"] = per(lambda s: evaluate.roc_points(s, label="y"))
    t["false_positives"] = per(lambda s: evaluate.false_positive_features(s, features, label="y"))
    t["attribution"] = _stack(
        {n: evaluate.false_positive_attribution(s, done[n].importances, label="y") for n, s in scored.items()}
    )
    t["importances"] = _stack({n: models.importance_table(df.sparkSession, m) for n, m in done.items()})
    t["rules"] = _stack({n: models.rule_table(df.sparkSession, m) for n, m in done.items()})
    t["split_ranges"] = _stack(
        {n: models.split_ranges(t["rules"].filter(F.col("label") == n)) for n in done}
    )

    t["split_counts"] = _stack({n: models.split_importance(t["rules"].filter(F.col("label") == n)) for n in done})
    used = {n: t["rules"].filter((F.col("label") == n) & F.col("feature").isin(list(features))) for n in done}
    t["value_ranges"] = _stack({n: models.used_value_ranges(rows, r) for n, r in used.items()})
    t["outcomes"] = per(lambda s: evaluate.outcome_counts(s, label="y"))
    t["uncertainty"] = per(lambda s: sensitivity.uncertainty(s))
    if fitted is not None:
        placed = ["pc1", "pc2"][: len(fitted.ratios)]
        t["outcome_points"] = per(lambda s: fitted.project(s, 2).select(*keys, evaluate.outcome("y", "prediction").alias("outcome"), *placed))
    members = reduce(
        lambda a, n: a.join(done[n].score(rows).select(*keys, F.col("prediction").alias(f"_{n}")), list(keys)), done, rows.select(*keys, *done)
    )
    t["status"] = evaluate.status_counts(members, [(n, f"_{n}") for n in done])

    stress = config.get("sensitivity_analysis", {})
    if stress.get("enabled", False):
        t["stability"] = _stack(
            {
                n: sensitivity.perturbation(rows, features, keys, m.score, stress.get("noise_levels", sensitivity.NOISE_LEVELS))
                for n, m in done.items()
            }
        )
        t["intervals"] = _stack(
            {
                n: sensitivity.bootstrap_intervals(
                    sensitivity.bootstrap_metrics(
                        m.score(rows), keys, stress.get("bootstrap_iterations", 100), label=n
                    ),
                    stress.get("confidence_level", 0.95),
                )
                for n, m in done.items()
            }
        )
        t["cv_stability"] = _stack(
            {n: sensitivity.repeated_cv(rows, features, n, keys, stress.get("cv_splits", 10), params=stress.get("fixed_model")) for n in done}
        )
        t["boundary"] = per(lambda s: sensitivity.boundary(s, label="y"))
        if stress.get("feature_ablation_enabled", False):
            t["ablation"] = _stack(
                {n: sensitivity.ablation(rows, features, n, keys, params=stress.get("fixed_model")) for n in done}
            )
        t["robustness"] = per(lambda s: sensitivity.threshold_robustness(s, label="y"))
        t["summary"] = sensitivity.sensitivity_summary(
            t["stability"], t["similarity"], t["cv_stability"], t["intervals"], t["robustness"]
        )
    return out
