"""Sums over pairs of columns, one matrix a task and group, so rows are read once and never copied."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nulls import as_column

#: Sums that a task holds before it hands them out.
HELD = 100_000


def group_sums(
    df: DataFrame, columns: Sequence[str], sums: Callable[[np.ndarray], dict[tuple[int, int], object]], fields: str,
    by: Sequence[str] = (), labels: Sequence[str] | None = None, overall: bool = True,
) -> DataFrame:
    """Partial sums of each group: (group columns, i, j, values), to be added up by (group, i, j).

    ``sums`` makes them from the group's rows in a batch, as {(i, j): value or array of values}. Groups are the values
    of ``by``, or the members of each 0/1 column in ``labels`` under the name ``label``, with all rows as ``overall``.
    """
    columns, by = list(columns), list(by)
    keys = [] if labels is not None else by
    flags = list(labels or ())
    inner = df.select(
        *[as_column(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], *[as_column(k).alias(k) for k in keys],
        *[(as_column(c) == 1).alias(f"f{i}") for i, c in enumerate(flags)],
    )
    group = [T.StructField("label", T.StringType())] if labels is not None else [df.schema[k] for k in keys]
    schema = T.StructType(group + T._parse_datatype_string(fields).fields)
    names = schema.names
    x = [f"x{i}" for i in range(len(columns))]

    def groups(pdf: pd.DataFrame):
        if labels is not None:
            if overall:
                yield ("overall",), pdf
            for i, c in enumerate(flags):
                yield (c,), pdf[pdf[f"f{i}"].fillna(False).astype(bool)]
        elif keys:
            yield from pdf.groupby(keys, dropna=False, sort=False)
        else:
            yield (), pdf

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, object] = {}
        for pdf in batches:
            for key, part in groups(pdf):
                if len(part):
                    key = tuple(None if isinstance(k, float) and np.isnan(k) else k for k in key)
                    for at, value in sums(part[x].to_numpy(float)).items():
                        held[key + at] = held[key + at] + value if key + at in held else value
            if len(held) > HELD:
                yield _table(held, names)
                held = {}
        if held:
            yield _table(held, names)

    return inner.mapInPandas(run, schema)


def _table(held: dict[tuple, object], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([(*k, *np.atleast_1d(v)) for k, v in held.items()], columns=names)


def pair_sums(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), labels: Sequence[str] | None = None) -> DataFrame:
    """Per group and pair i <= j: n, sums si and sj, squares qi and qj, products c, all over rows complete in the pair.

    Values are taken from a common ``shift`` of their column, so that a large mean costs no digits. The row with
    i = j = -1 counts all rows of the group.
    """
    columns = list(columns)
    p = len(columns)
    first = df.select(*[as_column(c).cast("double") for c in columns]).head()
    shift = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in first] if first else [0.0] * p)

    def sums(x: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        there = ~np.isnan(x)
        mask = there.astype(float)
        x = np.where(there, x - shift, 0.0)
        n, s, q, c = mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x
        out = {(i, j): np.array([n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], c[i, j]]) for i in range(p) for j in range(i, p)}
        out[-1, -1] = np.array([len(x), 0.0, 0.0, 0.0, 0.0, 0.0])
        return out

    values = ("n", "si", "sj", "qi", "qj", "c")
    parts = group_sums(df, columns, sums, "i int, j int, " + ", ".join(f"{v} double" for v in values), by, labels)
    names = [f.name for f in parts.schema.fields[: -2 - len(values)]]
    total = parts.groupBy(*names, "i", "j").agg(*[F.sum(v).alias(v) for v in values])
    at = F.get(F.array(*[F.lit(float(v)) for v in shift]), F.col("i"))
    return total.withColumn("n", F.col("n").cast("long")).withColumn("shift", F.when(F.col("i") >= 0, at))
