"""Threshold subsets: 0/1 flags from condition lists under an optional parent label, and their report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import Condition, combine, restrict_to_parent
from ..functions.groups import by_label
from ..functions.nulls import as_column, numeric_columns


@dataclass(frozen=True)
class Subset:
    name: str
    conditions: tuple[Condition, ...]
    parent: str | None = None
    logic: str = "and"
    description: str = ""

    @staticmethod
    def of(spec: Subset | Mapping[str, Any]) -> Subset:
        if isinstance(spec, Subset):
            return spec
        return Subset(
            spec["name"],
            tuple(Condition.of(c) for c in spec["conditions"]),
            spec.get("parent_domain"),
            spec.get("logic", "and"),
            spec.get("description", ""),
        )


@dataclass
class SubsetPlan:
    subsets: list[Subset]
    members: dict[str, Column] = field(default_factory=dict)
    candidates: dict[str, Column] = field(default_factory=dict)
    conditions: dict[str, list[str]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def plan_subsets(
    df: DataFrame,
    subsets: Sequence[Subset | Mapping[str, Any]],
    aliases: Mapping[str, Sequence[str]] | None = None,
    on_invalid: str = "error",
) -> SubsetPlan:
    """Resolve every definition against the columns of ``df``.

    ``on_invalid='skip'`` skips bad conditions and ignores an absent parent, with a warning.
    """
    plan = SubsetPlan([Subset.of(s) for s in subsets])
    for s in plan.subsets:
        combined = combine(s.conditions, df.columns, s.logic, aliases, on_invalid)
        member, candidate = restrict_to_parent(combined.column, s.parent, df.columns, on_invalid)
        if s.parent is not None and s.parent not in df.columns:
            plan.warnings.append(f"{s.name}: parent label not found: {s.parent}")
        plan.members[s.name] = member.cast("int")
        plan.candidates[s.name] = candidate
        plan.conditions[s.name] = combined.descriptions
        plan.warnings += [f"{s.name}: {w}" for w in combined.warnings]
    return plan


def flag_subsets(
    df: DataFrame,
    subsets: Sequence[Subset | Mapping[str, Any]],
    aliases: Mapping[str, Sequence[str]] | None = None,
    on_invalid: str = "error",
    population: Column | None = None,
) -> tuple[DataFrame, SubsetPlan]:
    """Add one 0/1 column per subset in a single projection. ``population`` restricts the rows first."""
    if population is not None:
        df = df.filter(population)
    plan = plan_subsets(df, subsets, aliases, on_invalid)
    return df.select("*", *[c.alias(n) for n, c in plan.members.items()]), plan


def subset_report(df: DataFrame, plan: SubsetPlan) -> DataFrame:
    """Candidates, members, share of candidates (%) and conditions, one row per subset."""
    names = [s.name for s in plan.subsets]
    wide = df.agg(
        *[F.count_if(plan.candidates[n]).alias(f"c{i}") for i, n in enumerate(names)],
        *[F.count_if(as_column(n) == 1).alias(f"m{i}") for i, n in enumerate(names)],
    )
    rows = []
    for i, s in enumerate(plan.subsets):
        c, m = F.col(f"c{i}"), F.col(f"m{i}")
        share = F.coalesce(F.round(F.try_divide(m * F.lit(100.0), c.cast("double")), 2), F.lit(0.0))
        rows.append(
            F.struct(
                F.lit(s.name).alias("subset"),
                F.lit(s.parent).cast("string").alias("parent"),
                c.alias("candidates"),
                m.alias("members"),
                share.alias("percent"),
                F.lit("; ".join(plan.conditions[s.name])).alias("conditions"),
            )
        )
    return wide.select(F.inline(F.array(*rows)))


def subset_statistics(df: DataFrame, names: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, sample std, min, max of numeric columns among the members of each subset.

    Every numeric column by default; a column that is null for all members is left out.
    """
    columns = [c for c in (columns or numeric_columns(df)) if c not in names]
    aggs = []
    for i, c in enumerate(columns):
        v = as_column(c).cast("double")
        aggs += [
            F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
        ]
    wide = by_label(df, names, name="subset").groupBy("subset").agg(*aggs)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"{k}{i}").alias(k) for k in ("mean", "std", "min", "max")],
        )
        for i, c in enumerate(columns)
    ]
    return wide.select("subset", F.inline(F.array(*rows))).filter(F.col("mean").isNotNull())
