"""Derive -> label -> flag as one plan, driven by the three configuration sections."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame

from ..operators import labeling, subsets
from ..operators.features import FittedFeatures, fit_features


@dataclass
class LabelResult:
    df: DataFrame
    features: FittedFeatures
    labels: labeling.LabelPlan
    subsets: subsets.SubsetPlan
    add_labels: Callable[[DataFrame], DataFrame] = field(repr=False, default=lambda df: df)
    population: Column | None = field(repr=False, default=None)

    def apply(self, df: DataFrame) -> DataFrame:
        """Derived columns, labels and flags of other rows, batch or streaming."""
        out = self.add_labels(self.features.transform(df))
        if self.population is not None:
            out = out.filter(self.population)
        return out.select("*", *[c.alias(n) for n, c in self.subsets.members.items()])

    @property
    def label_names(self) -> list[str]:
        return list(self.labels.columns)

    @property
    def subset_names(self) -> list[str]:
        return list(self.subsets.members)

    def reports(self) -> dict[str, DataFrame]:
        out = {}
        if self.label_names:
            out["label_counts"] = labeling.label_counts(self.df, self.label_names)
            out["label_overlap"] = labeling.label_overlap(self.df, self.label_names)
            out["label_coverage"] = labeling.label_coverage(self.df, self.label_names)
        if self.subset_names:
            out["subsets"] = subsets.subset_report(self.df, self.subsets)
            out["subset_statistics"] = subsets.subset_statistics(self.df, self.subset_names)
        return out


def derive_label_flag(
    df: DataFrame, config: Mapping[str, Any], population: Column | None = None, on_invalid: str = "error"
) -> LabelResult:
    """Sections: feature_engineering, domain_labeling, domain_subsets. ``population`` restricts rows before the flags."""
    derived = config.get("feature_engineering", {})
    fitted = fit_features(df, derived.get("features", []) if derived.get("enabled", True) else [])
    out = fitted.transform(df)

    section = config.get("domain_labeling", {})
    chosen = section.get("labeling_options", {})
    options = labeling.MatchOptions(
        match_whole_word=chosen.get("match_whole_word", False),
        use_regex=chosen.get("use_regex", False),
        case_sensitive=section.get("case_sensitive", False),
        minimum_keyword_matches=chosen.get("minimum_keyword_matches", 1),
    )
    names = [labeling.Label.of(n, s) for n, s in section.get("domains", {}).items()]
    keep = "combined_text" if section.get("save_combined_text_column", False) else None
    def add_labels(rows: DataFrame) -> DataFrame:
        return labeling.label_rows(rows, names, section.get("text_columns", []), options, keep)[0]

    out, labels = labeling.label_rows(out, names, section.get("text_columns", []), options, keep)

    flags = config.get("domain_subsets", {})
    out, plan = subsets.flag_subsets(
        out, flags.get("subsets", []), flags.get("column_aliases"), on_invalid, population
    )
    return LabelResult(out, fitted, labels, plan, add_labels, population)
