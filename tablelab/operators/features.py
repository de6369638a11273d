"""Derived columns from declarative definitions.

Definitions are applied in order; a later one may use the output of an earlier one. Operations that
need the data (min-max, z-score, equal-width and equal-frequency bins) are fitted once; the fitted
steps are plain Column expressions that can be applied to any other frame, also a streaming one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import as_column, coerce, ratio
from ..functions.order import quantile_values


class FeatureError(ValueError):
    """A definition cannot be applied to this frame."""


@dataclass(frozen=True)
class Feature:
    name: str
    operation: str
    columns: tuple[str, ...] = ()
    params: Mapping[str, Any] = field(default_factory=dict)
    description: str = ""

    @staticmethod
    def of(spec: Feature | Mapping[str, Any]) -> Feature:
        if isinstance(spec, Feature):
            return spec
        return Feature(
            spec["name"],
            spec["operation"],
            tuple(spec.get("columns", ())),
            dict(spec.get("parameters", {})),
            spec.get("description", ""),
        )


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


# --- operations without a fit -------------------------------------------------------------------


def add(cols: Sequence[Column]) -> Column:
    """Row sum ignoring nulls; 0 when all are null."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])


def multiply(cols: Sequence[Column]) -> Column:
    """Row product ignoring nulls; 1 when all are null."""
    return reduce(lambda a, b: a * b, [F.coalesce(c, F.lit(1.0)) for c in cols])


def subtract(a: Column, b: Column) -> Column:
    return a - b


def divide(a: Column, b: Column, epsilon: float = 1e-10) -> Column:
    """a / (b + epsilon); epsilon is always added."""
    return F.try_divide(a, b + F.lit(float(epsilon)))


def log(c: Column, offset: float = 1.0) -> Column:
    return F.log(c + F.lit(float(offset)))


def log10(c: Column, offset: float = 1.0) -> Column:
    return F.log10(c + F.lit(float(offset)))


def sqrt(c: Column) -> Column:
    return F.sqrt(F.abs(c))


def power(c: Column, exponent: float = 2.0) -> Column:
    return _finite(F.pow(c, F.lit(float(exponent))))


def clip(c: Column, lower: float | None = None, upper: float | None = None) -> Column:
    out = None
    if lower is not None:
        out = F.when(c < float(lower), F.lit(float(lower)))
    if upper is not None:
        out = (F if out is None else out).when(c > float(upper), F.lit(float(upper)))
    return c if out is None else out.otherwise(c)


def interval_labels(edges: Sequence[float]) -> list[str]:
    return [f"({lo:.6g}, {hi:.6g}]" for lo, hi in zip(edges, edges[1:])]


def bin_by_edges(c: Column, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Right-closed bins, the lowest edge included; null outside."""
    names = list(labels) if labels is not None else interval_labels(edges)
    if len(names) != len(edges) - 1:
        raise FeatureError(f"{len(edges) - 1} bins need as many labels, got {len(names)}")
    out = F.when(c < float(edges[0]), F.lit(None).cast("string"))
    for hi, text in zip(edges[1:], names):
        out = out.when(c <= float(hi), F.lit(text))
    return out


def formula(text: str) -> Column:
    """Any Spark SQL scalar expression over the columns."""
    return F.expr(text)


def conditional(cases: Sequence[tuple[str, Any]], default: Any = None) -> Column:
    """The value of the first listed condition that holds, else the default."""
    out = None
    for condition, value in cases:
        out = (F if out is None else out).when(F.expr(condition), F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


# --- operations with a fit ------------------------------------------------------------------------


def equal_width_edges(lo: float, hi: float, bins: int) -> list[float]:
    """Edges over [lo, hi]; the first one is moved down by 0.1 % of the range so that lo falls inside."""
    if lo == hi:
        span = 0.001 * abs(lo) if lo != 0 else 0.001
        lo, hi = lo - span, hi + span
        return [lo + i * (hi - lo) / bins for i in range(bins)] + [hi]
    edges = [lo + i * ((hi - lo) / bins) for i in range(bins)] + [hi]
    edges[0] -= 0.001 * (hi - lo)
    return edges


def equal_frequency_edges(quantiles: Sequence[float]) -> list[float]:
    """Quantile edges without repeats."""
    return list(dict.fromkeys(quantiles))


def min_max(c: Column, lo: float | None, hi: float | None) -> Column:
    if lo is None or lo == hi:
        return F.lit(0.0)
    return (c - F.lit(lo)) / F.lit(hi - lo)


def z_score(c: Column, mean: float | None, std: float | None) -> Column:
    if not std:
        return F.lit(0.0)
    return (c - F.lit(mean)) / F.lit(std)


# --- driver -----------------------------------------------------------------------------------------


def _needs(n: int | None, at_least: int | None, got: int, op: str) -> None:
    if n is not None and got != n:
        raise FeatureError(f"{op} needs exactly {n} column(s), got {got}")
    if at_least is not None and got < at_least:
        raise FeatureError(f"{op} needs at least {at_least} columns, got {got}")


def _simple(f: Feature, c: list[Column]) -> Column | None:
    """The expression of an operation that needs no fit, or None if it needs one."""
    p = f.params
    op = f.operation
    if op in ("add", "multiply", "interaction"):
        _needs(None, 2 if op == "interaction" else 1, len(c), op)
        return add(c) if op == "add" else multiply(c)
    if op in ("subtract", "divide", "ratio"):
        _needs(2, None, len(c), op)
        if op == "subtract":
            return subtract(c[0], c[1])
        return divide(c[0], c[1], p.get("epsilon", 1e-10)) if op == "divide" else ratio(c[0], c[1])
    one: dict[str, Callable[[Column], Column]] = {
        "log": lambda x: log(x, p.get("offset", 1)),
        "log10": lambda x: log10(x, p.get("offset", 1)),
        "sqrt": sqrt,
        "power": lambda x: power(x, p.get("exponent", 2)),
        "polynomial": lambda x: power(x, p.get("degree", 2)),
        "abs": F.abs,
        "clip": lambda x: clip(x, p.get("lower"), p.get("upper")),
    }
    if op in one:
        _needs(1, None, len(c), op)
        return one[op](c[0])
    if op == "bin" and p.get("bins"):
        _needs(1, None, len(c), op)
        return bin_by_edges(c[0], p["bins"], p.get("labels"))
    if op == "formula":
        return formula(p["formula"])
    if op == "conditional":
        default = p.get("default", 0)
        return conditional([(x["condition"], x.get("value", default)) for x in p["conditions"]], default)
    if op in ("normalize", "standardize", "bin"):
        _needs(1, None, len(c), op)
        return None
    raise FeatureError(f"unknown operation: {op}")


@dataclass
class FittedFeatures:
    """Ordered (name, expression) steps plus what happened to each definition."""

    steps: list[tuple[str, Column]]
    outcomes: list[dict[str, Any]]

    def transform(self, df: DataFrame) -> DataFrame:
        for name, expr in self.steps:
            df = df.withColumn(name, expr)
        return df

    def report(self, df: DataFrame) -> DataFrame:
        """One row per definition; the non-null counts of all new columns come from one aggregate."""
        made = [o for o in self.outcomes if o["status"] == "created"]
        counts: dict[str, int] = {}
        if made:
            row = self.transform(df).agg(*[F.count(as_column(o["name"])).alias(o["name"]) for o in made]).first()
            counts = row.asDict()
        rows = [
            (o["name"], o["operation"], o["status"], str(dict(o["params"])), counts.get(o["name"]), o["error"])
            for o in self.outcomes
        ]
        return df.sparkSession.createDataFrame(
            rows, "name string, operation string, status string, params string, non_null long, error string"
        )


def _stats(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float | None]]:
    row = df.agg(
        *[
            F.struct(
                F.min(coerce(df, c)).alias("min"),
                F.max(coerce(df, c)).alias("max"),
                F.avg(coerce(df, c)).alias("mean"),
                F.stddev_samp(coerce(df, c)).alias("std"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    return {c: row[f"s{i}"].asDict() for i, c in enumerate(columns)}


def fit_features(df: DataFrame, definitions: Sequence[Feature | Mapping[str, Any]]) -> FittedFeatures:
    """Build every definition; a failing one is recorded and skipped."""
    features = [Feature.of(d) for d in definitions]
    current = df
    steps: list[tuple[str, Column]] = []
    outcomes: list[dict[str, Any]] = []
    known: dict[str, dict[str, float | None]] = {}

    def stats_for(column: str, position: int) -> dict[str, float | None]:
        # One aggregate serves this and every later fit over columns that exist already.
        if column not in known:
            wanted = [column] + [
                g.columns[0]
                for g in features[position:]
                if g.operation in ("normalize", "standardize", "bin")
                and len(g.columns) == 1
                and g.columns[0] in current.columns
            ]
            known.update(_stats(current, list(dict.fromkeys(wanted))))
        return known[column]

    for i, f in enumerate(features):
        outcome = {"name": f.name, "operation": f.operation, "params": f.params, "status": "created", "error": None}
        try:
            missing = [c for c in f.columns if c not in current.columns]
            if missing:
                raise FeatureError(f"missing columns: {', '.join(missing)}")
            cols = [coerce(current, c) for c in f.columns]
            expr = _simple(f, cols)
            if expr is None:
                source = f.columns[0]
                if f.operation in ("normalize", "standardize"):
                    s = stats_for(source, i)
                    expr = (
                        min_max(cols[0], s["min"], s["max"])
                        if f.operation == "normalize"
                        else z_score(cols[0], s["mean"], s["std"])
                    )
                else:
                    n = int(f.params.get("n_bins", 5))
                    method = f.params.get("method", "equal_width")
                    if method == "equal_width":
                        s = stats_for(source, i)
                        edges = equal_width_edges(s["min"], s["max"], n)
                    elif method == "equal_frequency":
                        q = quantile_values(current.select(cols[0].alias("v")), ["v"], [k / n for k in range(n + 1)])
                        edges = equal_frequency_edges(q["v"])
                    else:
                        raise FeatureError(f"unknown bin method: {method}")
                    expr = bin_by_edges(cols[0], edges, f.params.get("labels"))
            current = current.withColumn(f.name, expr)
            known.pop(f.name, None)
            steps.append((f.name, expr))
        except (FeatureError, AnalysisException, ParseException, KeyError, TypeError) as err:
            outcome["status"] = "failed"
            outcome["error"] = str(err).splitlines()[0] if str(err) else type(err).__name__
        outcomes.append(outcome)
    return FittedFeatures(steps, outcomes)


def engineer(df: DataFrame, definitions: Sequence[Feature | Mapping[str, Any]]) -> tuple[DataFrame, FittedFeatures]:
    fitted = fit_features(df, definitions)
    return fitted.transform(df), fitted
