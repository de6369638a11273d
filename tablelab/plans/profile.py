"""Profile of a cleaned table, and of a labelled one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from ..operators import models, profile, stats


def profile_table(df: DataFrame, features: Sequence[str], config: Mapping[str, Any] | None = None) -> dict[str, DataFrame]:
    """Statistics, missing values, correlations, histograms and PCA of the listed features."""
    config = config or {}
    features, _ = models.feature_columns(df, config.get("features", {}).get("numeric", features))
    matrix = stats.correlation_matrix(df, features)
    out = {
        "feature_statistics": profile.feature_statistics(df, features),
        "missing": profile.missing_summary(df),
        "correlation": matrix,
        "high_correlation": stats.high_pairs(matrix, features),
        "histograms": profile.histograms(df, features),
    }
    fitted = stats.fit_pca(df, features, config.get("pca_analysis", {}).get("n_components", 5))
    if fitted is not None:
        out["pca_variance"], out["pca_loadings"] = fitted.variance(df), fitted.loading_table(df)
    return out


def profile_labels(df: DataFrame, features: Sequence[str], labels: Sequence[str]) -> dict[str, DataFrame]:
    """How the features differ between labels."""
    features, _ = models.feature_columns(df, features)
    return {
        "by_label": profile.statistics_by_label(df, features, labels),
        "correlation": stats.correlation_by_label(df, features, labels),
        "distribution": profile.distribution_by_combination(df, features, labels),
        "normalised": profile.normalised_long(df, features, labels),
        "shares": profile.label_shares(df, labels),
    }
