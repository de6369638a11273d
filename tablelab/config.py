"""Configuration files: one JSON object with the sections of the runs.

The sections are plain dictionaries, read where they are used. ``unknown_keys`` names the keys no run
reads, so that a typing mistake does not pass silently.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

# Keys each section reads. "*" stands for free names (labels, columns).
READ: dict[str, Any] = {
    "column_handling": {"drop_columns", "keep_columns", "required_columns", "smiles_column"},
    "missing_value_handling": {
        "strategy", "missing_threshold_columns", "missing_threshold_rows", "drop_rows_with_missing_required", "missing_value_indicators",
    },
    "duplicate_handling": {"remove_duplicates", "duplicate_subset", "keep_strategy"},
    "text_cleaning": {"enabled", "strip_whitespace", "lowercase_columns"},
    "numeric_cleaning": {
        "enabled", "remove_negative_values_columns", "remove_zero_values_columns", "clip_outliers", "outlier_method",
        "outlier_multiplier", "outlier_columns",
    },
    "row_validation": {"rules", "separator_column", "separator"},
    "chemical_validation": {"enabled", "remove_disconnected_structures"},
    "data_type_enforcement": {"enabled", "integer_columns", "float_columns", "string_columns"},
    "feature_selection": {
        "enabled", "remove_constant_columns", "remove_quasi_constant_columns", "quasi_constant_threshold",
        "remove_highly_correlated", "correlation_threshold",
    },
    "filtering": {"enabled", "mw_range", "xlogp_range", "heavy_atom_range", "ranges"},
    "feature_engineering": {"enabled", "features"},
    "domain_labeling": {"domains", "text_columns", "labeling_options", "case_sensitive", "save_combined_text_column"},
    "domain_subsets": {"column_aliases", "subsets"},
    "processed_analysis": {"features", "pca_analysis"},
    "domain_analysis": {"categorical_features", "cv_folds", "test_size", "random_seed", "pca_analysis", "model_settings", "sensitivity_analysis"},
    "subdomain_analysis": {"categorical_features", "cv_folds", "test_size", "random_seed", "pca_analysis", "model_settings", "sensitivity_analysis"},
}


def load(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def unknown_keys(config: Mapping[str, Any]) -> list[str]:
    """Dotted names of the keys that no run reads."""
    out = []
    for section, keys in config.items():
        if section not in READ:
            out.append(section)
        elif isinstance(keys, Mapping):
            out += [f"{section}.{k}" for k in keys if k not in READ[section]]
    return sorted(out)
