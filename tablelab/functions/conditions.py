"""Declarative conditions -> Column, with the missing-value rules of the table world.

``==  <  <=  >  >=  between  in`` are false on null; ``!=  not_between  not_in`` are true on null.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nulls import as_column

_COMPARE = {"<=": operator.le, "<": operator.lt, ">=": operator.ge, ">": operator.gt, "==": operator.eq}
OPERATORS = (*_COMPARE, "!=", "between", "not_between", "in", "not_in")


class ConditionError(ValueError):
    """A condition names an unknown column or operator, or has a value of the wrong shape."""


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: Any

    @staticmethod
    def of(spec: Condition | Mapping[str, Any]) -> Condition:
        return spec if isinstance(spec, Condition) else Condition(spec["column"], spec["operator"], spec["value"])


def resolve_column(name: str, columns: Sequence[str], aliases: Mapping[str, Sequence[str]] | None = None) -> str | None:
    """Find the real column: exact name, then the alias groups in order, then ignoring case."""
    if name in columns:
        return name
    for canonical, group in (aliases or {}).items():
        if name == canonical or name in group:
            hit = next((a for a in group if a in columns), None)
            if hit is not None:
                return hit
    folded = {c.lower(): c for c in reversed(list(columns))}
    return folded.get(name.lower())


def predicate(col: Column, op: str, value: Any) -> Column:
    """One comparison as a never-null boolean."""
    if op in _COMPARE:
        return F.coalesce(_COMPARE[op](col, F.lit(value)), F.lit(False))
    if op == "!=":
        return ~col.eqNullSafe(F.lit(value))
    if op in ("between", "not_between"):
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            raise ConditionError(f"{op} needs [low, high], not {value!r}")
        inside = F.coalesce(col.between(F.lit(value[0]), F.lit(value[1])), F.lit(False))
        return inside if op == "between" else ~inside
    if op in ("in", "not_in"):
        if not isinstance(value, (list, tuple, set)):
            raise ConditionError(f"{op} needs a list, not {value!r}")
        member = F.coalesce(col.isin(list(value)), F.lit(False))
        return member if op == "in" else ~member
    raise ConditionError(f"unknown operator: {op}")


def describe(column: str, op: str, value: Any) -> str:
    if op == "between":
        return f"{column} BETWEEN {value[0]} AND {value[1]}"
    if op == "not_between":
        return f"{column} NOT BETWEEN {value[0]} AND {value[1]}"
    if op in ("in", "not_in"):
        return f"{column} {'IN' if op == 'in' else 'NOT IN'} {list(value)}"
    return f"{column} {op} {value}"


def build(
    spec: Condition | Mapping[str, Any], columns: Sequence[str], aliases: Mapping[str, Sequence[str]] | None = None
) -> tuple[Column, str]:
    """Column and description of one condition; ``ConditionError`` when it cannot be built."""
    c = Condition.of(spec)
    real = resolve_column(c.column, columns, aliases)
    if real is None:
        raise ConditionError(f"column not found: {c.column}")
    return predicate(as_column(real), c.operator, c.value), describe(real, c.operator, c.value)


@dataclass
class Combined:
    column: Column
    descriptions: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def combine(
    specs: Sequence[Condition | Mapping[str, Any]],
    columns: Sequence[str],
    logic: str = "and",
    aliases: Mapping[str, Sequence[str]] | None = None,
    on_invalid: str = "error",
) -> Combined:
    """Fold conditions with AND / OR. ``on_invalid='skip'`` drops bad ones with a warning.

    With no valid condition left nothing matches.
    """
    if logic not in ("and", "or"):
        raise ConditionError(f"logic must be 'and' or 'or', not {logic!r}")
    if on_invalid not in ("error", "skip"):
        raise ValueError(f"on_invalid must be 'error' or 'skip', not {on_invalid!r}")
    built: list[Column] = []
    out = Combined(F.lit(False))
    for spec in specs:
        try:
            col, text = build(spec, columns, aliases)
        except ConditionError as err:
            if on_invalid == "error":
                raise
            out.warnings.append(str(err))
            continue
        built.append(col)
        out.descriptions.append(text)
    if built:
        out.column = reduce(operator.and_ if logic == "and" else operator.or_, built)
    return out


def restrict_to_parent(
    condition: Column, parent: str | None, columns: Sequence[str], on_missing: str = "error"
) -> tuple[Column, Column]:
    """(membership, candidate) columns: candidates are the parent's members, or every row without a parent."""
    if parent is None:
        return condition, F.lit(True)
    if parent not in columns:
        if on_missing == "error":
            raise ConditionError(f"parent label not found: {parent}")
        return condition, F.lit(True)
    candidate = F.coalesce(as_column(parent) == 1, F.lit(False))
    return condition & candidate, candidate


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with no missing value in ``columns``."""
    return df.dropna(how="any", subset=list(columns))


def measured_only(value: str, origin: str, wanted: str = "measured") -> Column:
    """Mask of rows with a value whose provenance is ``wanted``."""
    return as_column(value).isNotNull() & F.coalesce(as_column(origin) == wanted, F.lit(False))
