"""The cleaning run: ordered steps from one configuration, with rows and columns accounted per step.

Between two points that need data (fits), everything stays one lazy plan. Row filters of a section
are counted by one aggregate over the first failing step; duplicates split sections, because they
must see survivors only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import MISSING_TEXTS, coerce
from ..operators import clean as ops
from ..operators.profile import column_statistics
from ..session import checkpointed

# Range options and the column each one filters.
RANGE_COLUMNS = {"mw_range": "mw", "xlogp_range": "xlogp", "heavy_atom_range": "heavycnt"}


@dataclass
class CleanResult:
    df: DataFrame
    steps: list[dict[str, Any]] = field(default_factory=list)
    fitted: dict[str, Any] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    #: What the steps met: ``required_columns``, ``dropped_rows`` and ``nulled_values``. They are counted when asked for.
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def column_statistics(self) -> DataFrame:
        """Type, values, nulls, distinct values and for numbers the distribution of each column that is left."""
        return column_statistics(self.df)

    def report(self) -> DataFrame:
        """One row per step: rows before, after, removed, retention % of the first count, columns after."""
        first = self.steps[0]["before"] if self.steps else 0
        rows = [
            (
                i, s["step"], s["before"], s["after"], s["before"] - s["after"],
                round(100.0 * s["after"] / first, 2) if first else 0.0, s["columns"], s["detail"],
            )
            for i, s in enumerate(self.steps, start=1)
        ]
        return self.df.sparkSession.createDataFrame(
            rows,
            "position int, step string, rows_before long, rows_after long, removed long, "
            "retained_pct double, n_columns int, detail string",
        )


class _Run:
    """Rows are only known after a section's count; steps recorded before it are completed then."""

    def __init__(self, df: DataFrame):
        self.result = CleanResult(df)
        self.rows: int | None = None
        self.open: list[dict[str, Any]] = []

    @property
    def df(self) -> DataFrame:
        return self.result.df

    def change(self, step: str, df: DataFrame, detail: str = "", removes_rows: bool = False) -> None:
        self.result.df = df
        self._record(step, detail, removes_rows)

    def _record(self, step: str, detail: str, removes_rows: bool) -> None:
        row = {"step": step, "detail": detail, "columns": len(self.df.columns), "before": self.rows, "after": None}
        row["removes"] = removes_rows
        self.open.append(row)
        self.result.steps.append(row)
        if removes_rows:
            self.rows = None

    def section(self, filters: Sequence[tuple[str, Column]]) -> None:
        if filters:
            kept, removed, total = ops.run_row_steps(self.df, filters)
        else:
            kept, removed, total = self.df, {}, self.df.count()
        self._settle(total)
        for name, _ in filters:
            after = self.rows - removed[name]
            self.result.steps.append(
                {"step": name, "detail": "", "columns": len(self.df.columns), "before": self.rows, "after": after}
            )
            self.rows = after
        self.result.df = kept

    def _settle(self, total: int) -> None:
        for row in self.open:
            row["before"] = total if row["before"] is None else row["before"]
            row["after"] = total if row["removes"] or row["before"] == total else row["before"]
        self.open.clear()
        self.rows = total


# The names of sections and options in the configuration, here and below.
def _fits_later(config: Mapping[str, Any]) -> bool:
    """Does any step after the removal of duplicates look at the data before the final count?"""
    on = lambda section, *keys: (
        config.get(section, {}).get("enabled", False) and (not keys or any(config[section].get(k, False) for k in keys))
    )
    return bool(
        on("numeric_cleaning", "clip_outliers")
        or on("data_type_enforcement")
        or on("chemical_validation", "remove_disconnected_structures")
        or config.get("row_validation")
        or on("feature_selection", "remove_constant_columns", "remove_quasi_constant_columns", "remove_highly_correlated")
    )


def clean(
    df: DataFrame, config: Mapping[str, Any], order: Sequence[str], checkpoint: bool | None = None
) -> CleanResult:
    """Run the configured steps. ``order`` names the columns that say which copy of a duplicate is first.

    ``checkpoint`` writes the de-duplicated table once to the shared folder, so that later fits do
    not repeat its shuffle; by default it is written when there are such fits.
    """
    columns = config.get("column_handling", {})
    missing = config.get("missing_value_handling", {})
    run = _Run(df)

    run.change("missing_indicators", ops.standardise_missing(df, missing.get("missing_value_indicators", MISSING_TEXTS)))
    run.change("drop_columns", ops.drop_columns(run.df, columns.get("drop_columns", [])))
    run.change("keep_columns", ops.keep_columns(run.df, columns.get("keep_columns")))
    high = ops.fit_high_missing(run.df, missing.get("missing_threshold_columns", 0.9))
    run.result.fitted["high_missing"] = high
    run.change("high_missing_columns", run.df.drop(*high), ", ".join(high))

    types = config.get("data_type_enforcement", {})
    required = ops.existing(run.df, columns.get("required_columns", []))
    if columns.get("required_columns"):
        run.result.tables["required_columns"] = ops.missing_breakdown(run.df, columns["required_columns"])
    run.result.tables["dropped_rows"] = ops.dropped_row_stats(run.df, missing.get("missing_threshold_rows", 0.5))
    filters = [("high_missing_rows", ops.enough_values(run.df.columns, missing.get("missing_threshold_rows", 0.5)))]
    if missing.get("drop_rows_with_missing_required", False) and required:
        filters.append(("missing_required", ops.has_all(required)))
    if missing.get("strategy") == "drop_rows":
        numbers = ops.numeric_without_required(
            run.df, types.get("integer_columns", []), types.get("float_columns", []), required
        )
        filters.append(("missing_numeric", ops.has_all(numbers)))
    run.section(filters)

    copies = config.get("duplicate_handling", {})
    if copies.get("remove_duplicates", False):
        subset = copies.get("duplicate_subset")
        unique = ops.deduplicate(run.df, subset, order, copies.get("keep_strategy", "first"))
        run.change("duplicates", unique, ", ".join(subset or []), removes_rows=True)
        if _fits_later(config) if checkpoint is None else checkpoint:
            run.result.df = checkpointed(run.df)

    text = config.get("text_cleaning", {})
    if text.get("enabled", False):
        if text.get("strip_whitespace", True):
            run.change("strip_text", ops.strip_text(run.df))
        run.change("lower_text", ops.lower_text(run.df, text.get("lowercase_columns", [])))

    numeric = config.get("numeric_cleaning", {})
    if numeric.get("enabled", False):
        nulled = []
        for step, key, test, change in (
            ("null_negatives", "remove_negative_values_columns", lambda v: v < 0, ops.null_negatives),
            ("null_zeros", "remove_zero_values_columns", lambda v: v == 0, ops.null_zeros),
        ):
            listed = ops.existing(run.df, numeric.get(key, []))
            if listed:
                nulled.append(ops.count_where(run.df, listed, test).withColumn("step", F.lit(step)))
            run.change(step, change(run.df, listed))
        if numeric.get("clip_outliers", False):
            bounds = ops.fit_outlier_bounds(
                run.df,
                numeric.get("outlier_columns", []),
                numeric.get("outlier_method", "iqr"),
                numeric.get("outlier_multiplier", 3.0),
            )
            run.result.fitted["outlier_bounds"] = bounds
            if bounds:
                nulled.append(ops.outlier_counts(run.df, bounds).withColumn("step", F.lit("null_outliers")))
            run.change("null_outliers", ops.null_outliers(run.df, bounds), ", ".join(bounds))

        if nulled:
            run.result.tables["nulled_values"] = reduce(DataFrame.unionByName, nulled).select("step", "column", "n")

    filters = _validation_filters(run.df, config)
    if filters:
        run.section(filters)

    if types.get("enabled", False):
        whole, fractional = ops.fit_integers(run.df, types.get("integer_columns", []))
        run.result.fitted["integers"] = whole
        run.result.warnings += [f"{c}: has fractional values, left unchanged" for c in fractional]
        run.change(
            "types", ops.enforce_types(run.df, whole, types.get("float_columns", []), types.get("string_columns", []))
        )

    selection = config.get("feature_selection", {})
    if selection.get("enabled", False):
        gone: list[str] = []
        if selection.get("remove_constant_columns", False):
            gone += ops.fit_constant(run.df)
        if selection.get("remove_quasi_constant_columns", False):
            rest = run.df.drop(*gone)
            gone += list(ops.fit_quasi_constant(rest, selection.get("quasi_constant_threshold", 0.99)))
        run.change("constant_columns", run.df.drop(*gone), ", ".join(gone))
        run.result.fitted["constant"] = gone
        if selection.get("remove_highly_correlated", False):
            twins = ops.fit_correlated(run.df, ops.numeric_only(run.df), selection.get("correlation_threshold", 0.95))
            run.result.fitted["correlated"] = twins
            run.change("correlated_columns", run.df.drop(*twins), ", ".join(twins))

    run.section(_range_filters(run.df, config))
    return run.result


def _validation_filters(df: DataFrame, config: Mapping[str, Any]) -> list[tuple[str, Column]]:
    """Named conditions of the sections row_validation and chemical_validation."""
    checks = config.get("row_validation", {})
    filters = [
        (f"invalid_{c['column']}", ops.is_valid(c["column"], F.expr(c["predicate"])))
        for c in checks.get("rules", [])
        if c.get("drop", True) and c["column"] in df.columns
    ]
    structures = config.get("chemical_validation", {})
    separated = checks.get("separator_column")
    if structures.get("enabled", False) and structures.get("remove_disconnected_structures", False):
        separated = config.get("column_handling", {}).get("smiles_column")
    if separated and separated in df.columns:
        filters.append(("separator", ops.without_text(separated, checks.get("separator", "."))))
    return filters


def _range_filters(df: DataFrame, config: Mapping[str, Any]) -> list[tuple[str, Column]]:
    """Named conditions of the section filtering."""
    ranges = config.get("filtering", {})
    if not ranges.get("enabled", False):
        return []
    wanted = {RANGE_COLUMNS[k]: v for k, v in ranges.items() if k in RANGE_COLUMNS and v}
    wanted |= ranges.get("ranges", {})
    return [(f"range_{c}", ops.in_range(coerce(df, c), float(lo), float(hi))) for c, (lo, hi) in wanted.items() if c in df.columns]


def _kept(df: DataFrame, filters: list[tuple[str, Column]]) -> DataFrame:
    for _, condition in filters:
        df = df.filter(condition)
    return df


def apply_fitted(df: DataFrame, result: CleanResult, config: Mapping[str, Any]) -> DataFrame:
    """The row-wise part of a finished run on other rows, batch or streaming: same columns, bounds and types.

    Duplicate removal is left out, as it is not row-wise.
    """
    columns = config.get("column_handling", {})
    missing = config.get("missing_value_handling", {})
    types = config.get("data_type_enforcement", {})
    fitted = result.fitted
    out = ops.standardise_missing(df, missing.get("missing_value_indicators", MISSING_TEXTS))
    out = ops.keep_columns(ops.drop_columns(out, columns.get("drop_columns", [])), columns.get("keep_columns"))
    out = out.drop(*fitted.get("high_missing", {}))
    out = out.filter(ops.enough_values(out.columns, missing.get("missing_threshold_rows", 0.5)))
    required = ops.existing(out, columns.get("required_columns", []))
    if missing.get("drop_rows_with_missing_required", False) and required:
        out = out.filter(ops.has_all(required))
    if missing.get("strategy") == "drop_rows":
        out = out.filter(
            ops.has_all(
                ops.numeric_without_required(out, types.get("integer_columns", []), types.get("float_columns", []), required)
            )
        )
    text = config.get("text_cleaning", {})
    if text.get("enabled", False):
        out = ops.strip_text(out) if text.get("strip_whitespace", True) else out
        out = ops.lower_text(out, text.get("lowercase_columns", []))
    numeric = config.get("numeric_cleaning", {})
    if numeric.get("enabled", False):
        out = ops.null_negatives(out, numeric.get("remove_negative_values_columns", []))
        out = ops.null_zeros(out, numeric.get("remove_zero_values_columns", []))
    out = ops.null_outliers(out, {c: b for c, b in fitted.get("outlier_bounds", {}).items() if c in out.columns})
    out = _kept(out, _validation_filters(out, config))
    if types.get("enabled", False):
        out = ops.enforce_types(out, fitted.get("integers", []), types.get("float_columns", []), types.get("string_columns", []))
    out = out.drop(*fitted.get("constant", []), *fitted.get("correlated", []))
    return _kept(out, _range_filters(out, config))


