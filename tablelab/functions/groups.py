"""0/1 label columns seen as groups of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nulls import as_column

OVERALL = "overall"


def set_labels(labels: Sequence[str], overall: bool = False) -> Column:
    """Array with the names of the labels that are 1 on the row, led by the 'overall' member if wanted."""
    members = [F.when(as_column(name) == 1, F.lit(name)) for name in labels]
    if overall:
        members.insert(0, F.lit(OVERALL))
    return F.array_compact(F.array(*members))


def by_label(df: DataFrame, labels: Sequence[str], overall: bool = False, name: str = "label") -> DataFrame:
    """One copy of the row per set label. No shuffle; later aggregates combine on the map side."""
    return df.withColumn(name, F.explode(set_labels(labels, overall)))


def to_long(df: DataFrame, keys: Sequence[str], per_column: dict[str, dict[str, Column]], name: str = "column") -> DataFrame:
    """Turn a wide one-row-per-key aggregate into one row per (key, column).

    ``per_column`` maps the original column to {output name: expression over df}.
    """
    rows = [
        F.struct(F.lit(c).alias(name), *[expr.alias(out) for out, expr in outs.items()])
        for c, outs in per_column.items()
    ]
    return df.select(*keys, F.inline(F.array(*rows)))
