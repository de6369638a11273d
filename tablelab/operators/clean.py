"""Cleaning, typing and column selection.

Operators whose result depends on the data come as a ``fit`` (one aggregate, a small Python value)
and an application (plain expressions), so that the same fit can be applied to new or streaming rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.groups import to_long
from ..functions.nulls import (
    MISSING_TEXTS,
    as_column,
    coerce,
    exact_number,
    is_floating,
    is_numeric,
    ratio,
    string_columns,
    strip,
    whole_number,
)
from ..functions.order import exact_quantiles, keep_one
from .stats import correlation_values

# --- columns --------------------------------------------------------------------------------------


def existing(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Listed columns that exist, in listed order, each once."""
    return [c for c in dict.fromkeys(columns) if c in df.columns]


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*existing(df, columns))


def keep_columns(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    return df if columns is None else df.select(*[as_column(c) for c in existing(df, columns)])


def missing_shares(df: DataFrame) -> dict[str, float]:
    row = df.agg(*[F.avg(as_column(c).isNull().cast("int")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return {c: row[f"c{i}"] or 0.0 for i, c in enumerate(df.columns)}


def fit_high_missing(df: DataFrame, threshold: float = 0.9) -> dict[str, float]:
    """Columns whose null share is above the threshold, with the share."""
    return {c: s for c, s in missing_shares(df).items() if s > threshold}


def fit_constant(df: DataFrame) -> list[str]:
    """Columns with at most one distinct non-null value: min = max in one pass, no distinct count."""
    row = df.agg(
        *[
            F.coalesce(F.min(as_column(c)) == F.max(as_column(c)), F.lit(True)).alias(f"c{i}")
            for i, c in enumerate(df.columns)
        ]
    ).first()
    return [c for i, c in enumerate(df.columns) if row[f"c{i}"]]


def value_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of the most frequent value among the non-null values of each column."""
    columns = list(columns or df.columns)
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), as_column(c).cast("string").alias("value")) for c in columns]
    )
    return (
        df.select(F.inline(cells))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
        .groupBy("column")
        .agg(ratio(F.max("n"), F.sum("n")).alias("top_share"))
    )


def fit_quasi_constant(df: DataFrame, threshold: float = 0.99) -> dict[str, float]:
    """Columns whose most frequent value holds at least ``threshold`` of the non-null values.

    A value with clearly more than half of the rows sits at the median of any ordering, so the
    approximate median of the value hashes names the only possible candidate and a second aggregate
    counts it exactly: no shuffle of distinct values. Lower thresholds count all values.
    """
    columns = df.columns
    if threshold < 0.51:
        rows = value_shares(df).filter(F.col("top_share") >= threshold).collect()
        return {r["column"]: r["top_share"] for r in rows}
    # 52 bits, because the sketch works on doubles.
    hashes = {c: F.when(as_column(c).isNotNull(), F.shiftrightunsigned(F.xxhash64(as_column(c)), 12)) for c in columns}
    middle = df.agg(*[F.percentile_approx(hashes[c], 0.5, 1000).alias(f"h{i}") for i, c in enumerate(columns)]).first()
    aggs = []
    for i, c in enumerate(columns):
        hit = hashes[c] == F.lit(middle[f"h{i}"])
        only = F.when(hit, as_column(c))
        aggs += [
            F.count(as_column(c)).alias(f"n{i}"),
            F.count_if(hit).alias(f"k{i}"),
            (F.min(only) == F.max(only)).alias(f"one{i}"),
        ]
    row = df.agg(*aggs).first()
    found: dict[str, float] = {}
    for i, c in enumerate(columns):
        n, k = row[f"n{i}"], row[f"k{i}"]
        if not n or k / n < threshold:
            continue
        if row[f"one{i}"]:
            found[c] = k / n
        else:  # two values share the candidate hash: count this column in full
            share = value_shares(df, [c]).first()["top_share"]
            if share >= threshold:
                found[c] = share
    return found


def correlated_columns(columns: Sequence[str], r: Mapping[tuple[str, str], float | None], threshold: float) -> list[str]:
    """Later columns of a pair above the threshold; a column dropped already can still cause drops."""
    return [
        c
        for j, c in enumerate(columns)
        if any(abs(r.get((columns[i], c)) or 0.0) > threshold for i in range(j))
    ]


def fit_correlated(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> list[str]:
    return correlated_columns(list(columns), correlation_values(df, columns), threshold)


# --- missing values -----------------------------------------------------------------------------


def standardise_missing(df: DataFrame, texts: Sequence[str] = MISSING_TEXTS) -> DataFrame:
    """Texts that stand for 'missing', white-space-only text and NaN become null."""
    changed: dict[str, Column] = {}
    for f in df.schema.fields:
        c = as_column(f.name)
        if isinstance(f.dataType, T.StringType):
            changed[f.name] = F.when(~(c.isin(list(texts)) | c.rlike(r"^(?U)\s*$")), c)
        elif is_floating(f.dataType):
            changed[f.name] = F.when(~F.isnan(c), c)
    return df.withColumns(changed) if changed else df


def missing_count(columns: Sequence[str]) -> Column:
    return reduce(operator.add, [as_column(c).isNull().cast("int") for c in columns], F.lit(0))


def enough_values(columns: Sequence[str], threshold: float = 0.5) -> Column:
    """Keep predicate: the missing share of the row is at most ``threshold``."""
    return missing_count(columns) / F.lit(float(len(columns))) <= F.lit(float(threshold))


def dropped_row_stats(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows dropped by ``enough_values`` with min, max and mean missing % among them."""
    share = missing_count(df.columns) * F.lit(100.0) / F.lit(float(len(df.columns)))
    out = F.when(~enough_values(df.columns, threshold), share)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count(out).alias("dropped"),
        F.min(out).alias("min_missing_pct"),
        F.max(out).alias("max_missing_pct"),
        F.avg(out).alias("avg_missing_pct"),
    )


def has_all(columns: Sequence[str]) -> Column:
    """Keep predicate: no listed column is null."""
    return reduce(operator.and_, [as_column(c).isNotNull() for c in columns], F.lit(True))


def missing_breakdown(df: DataFrame, columns: Sequence[str], only_missing: bool = False) -> DataFrame:
    """Per column: missing, missing %, with value. Absent columns are reported as such."""
    here = existing(df, columns)
    absent = [c for c in dict.fromkeys(columns) if c not in here]
    wide = df.agg(F.count("*").alias("n"), *[F.count(as_column(c)).alias(f"c{i}") for i, c in enumerate(here)])
    per = {
        c: {
            "present": F.lit(True),
            "missing": F.col("n") - F.col(f"c{i}"),
            "missing_pct": F.round(ratio((F.col("n") - F.col(f"c{i}")) * 100, F.col("n")), 2),
            "with_value": F.col(f"c{i}"),
        }
        for i, c in enumerate(here)
    }
    nothing = F.lit(None).cast("long")
    per |= {
        c: {"present": F.lit(False), "missing": nothing, "missing_pct": nothing.cast("double"), "with_value": nothing}
        for c in absent
    }
    out = to_long(wide, [], per)
    return out.filter(F.col("missing") > 0) if only_missing else out


def numeric_without_required(df: DataFrame, integers: Sequence[str], floats: Sequence[str], required: Sequence[str]) -> list[str]:
    return [c for c in existing(df, [*integers, *floats]) if c not in required]


def deduplicate(df: DataFrame, subset: Sequence[str] | None, order: Sequence[str], keep: str | bool = "first") -> DataFrame:
    """Drop copies (nulls equal). ``order`` decides which copy is first; it needs a unique tie-breaker."""
    columns = existing(df, subset) if subset else []
    return keep_one(df, columns or df.columns, order, keep)


# --- text and numbers --------------------------------------------------------------------------


def strip_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = string_columns(df) if columns is None else existing(df, columns)
    return df.withColumns({c: strip(c) for c in names}) if names else df


def lower_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    names = existing(df, columns)
    return df.withColumns({c: F.lower(as_column(c)) for c in names}) if names else df


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    names = existing(df, columns)
    return df.withColumns({c: exact_number(df, c) for c in names}) if names else df


def null_negatives(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    values = {c: exact_number(df, c) for c in existing(df, columns)}
    return df.withColumns({c: F.when(~(v < 0), v) for c, v in values.items()}) if values else df


def null_zeros(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    values = {c: exact_number(df, c) for c in existing(df, columns)}
    return df.withColumns({c: F.when(~(v == 0), v) for c, v in values.items()}) if values else df


def count_where(df: DataFrame, columns: Sequence[str], test) -> DataFrame:
    """Per column: number of coerced values for which ``test(value)`` holds."""
    names = existing(df, columns)
    wide = df.agg(*[F.count_if(test(coerce(df, c))).alias(f"c{i}") for i, c in enumerate(names)])
    return to_long(wide, [], {c: {"n": F.col(f"c{i}")} for i, c in enumerate(names)})


def fit_outlier_bounds(
    df: DataFrame, columns: Sequence[str], method: str = "iqr", multiplier: float = 3.0
) -> dict[str, tuple[float, float]]:
    """Bounds per column: quartiles -/+ m * IQR, or mean -/+ m * sample std. An unknown method gives none."""
    names = existing(df, columns)
    if not names:
        return {}
    values = df.select(*[coerce(df, c).alias(c) for c in names])
    if method == "iqr":
        bounds = {}
        for r in exact_quantiles(values, names, [0.25, 0.75]).collect():
            if r["q"]:
                q1, q3 = r["q"]
                bounds[r["column"]] = (q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1))
        return bounds
    if method == "zscore":
        row = values.agg(
            *[F.struct(F.avg(as_column(c)), F.stddev_samp(as_column(c))).alias(c) for c in names]
        ).first()
        return {
            c: (row[c][0] - multiplier * row[c][1], row[c][0] + multiplier * row[c][1])
            for c in names
            if row[c][1] is not None
        }
    return {}


def null_outliers(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Values strictly outside their bounds become null; the rows stay, and whole and decimal numbers keep their type."""
    changed = {}
    for c, (lo, hi) in bounds.items():
        v = coerce(df, c)
        changed[c] = F.when(~((v < lo) | (v > hi)), exact_number(df, c))
    return df.withColumns(changed) if changed else df


def outlier_counts(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Per column: number of coerced values strictly outside their bounds."""
    outside = {c: (coerce(df, c) < lo) | (coerce(df, c) > hi) for c, (lo, hi) in bounds.items()}
    wide = df.agg(*[F.count_if(test).alias(f"c{i}") for i, test in enumerate(outside.values())])
    return to_long(wide, [], {c: {"n": F.col(f"c{i}")} for i, c in enumerate(outside)})


def fit_integers(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """(columns whose values are all whole, columns with a fractional value)."""
    names = existing(df, columns)
    if not names:
        return [], []
    row = df.agg(*[F.count_if(coerce(df, c) != F.floor(coerce(df, c))).alias(f"c{i}") for i, c in enumerate(names)]).first()
    whole = [c for i, c in enumerate(names) if row[f"c{i}"] == 0]
    return whole, [c for c in names if c not in whole]


def enforce_types(
    df: DataFrame, whole: Sequence[str] = (), floats: Sequence[str] = (), strings: Sequence[str] = ()
) -> DataFrame:
    """Cast to the three type families; ``whole`` comes from ``fit_integers``."""
    changed: dict[str, Column] = {}
    for c in existing(df, whole):
        changed[c] = whole_number(df, c)
    for c in existing(df, floats):
        changed[c] = coerce(df, c)
    for c in existing(df, strings):
        changed[c] = F.nullif(as_column(c).cast("string"), F.lit("nan"))
    return df.withColumns(changed) if changed else df


# --- row checks ---------------------------------------------------------------------------------


def is_valid(column: str, predicate: Column) -> Column:
    """Never-null validity: a null value is invalid."""
    return F.coalesce(as_column(column).isNotNull() & predicate, F.lit(False))


def validate(df: DataFrame, column: str, predicate: Column, drop: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, one-row report of valid and invalid counts); invalid rows go when ``drop``."""
    ok = is_valid(column, predicate)
    report = df.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))
    return (df.filter(ok) if drop else df), report


def without_text(column: str, separator: str = ".") -> Column:
    """Keep predicate: the text does not contain the separator; null is kept."""
    return ~F.coalesce(as_column(column).contains(separator), F.lit(False))


def in_range(value: Column, lo: float, hi: float) -> Column:
    """Keep predicate: lo <= value <= hi, or the value is missing."""
    return value.between(F.lit(lo), F.lit(hi)) | value.isNull()


def first_value(*columns: str) -> Column:
    """The primary measurement, else the fallbacks in order."""
    return F.coalesce(*[as_column(c) for c in columns])


# --- step accounting -----------------------------------------------------------------------------


def failing_step(steps: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first step whose keep predicate does not hold; null for rows that stay."""
    return F.coalesce(*[F.when(~keep, F.lit(name)) for name, keep in steps], F.lit(None).cast("string"))


def run_row_steps(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> tuple[DataFrame, dict[str, int], int]:
    """Apply keep predicates in sequence: (kept rows, removed per step, rows before), one job for all counts."""
    if not steps:
        return df, {}, -1
    counts = df.groupBy(failing_step(steps).alias("step")).count().collect()
    removed = {name: 0 for name, _ in steps}
    total = 0
    for r in counts:
        total += r["count"]
        if r["step"] is not None:
            removed[r["step"]] = r["count"]
    keep = reduce(operator.and_, [k for _, k in steps])
    return df.filter(keep), removed, total


def numeric_only(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]
