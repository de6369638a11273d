"""Correlation, scaling, PCA and within-group similarity."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import complete_cases
from ..functions.moments import group_sums, pair_sums
from ..functions.nulls import as_column, ratio

# --- correlation ----------------------------------------------------------------------------------


def correlation_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long Pearson matrix (a, b, r) over pairwise-complete rows; r is null for a constant column or too few rows.

    ``n`` counts the group's rows.
    """
    return _correlations(pair_sums(df, columns, by=by), list(columns), list(by))


def _correlations(sums: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    cov = F.col("c") - F.col("si") * F.col("sj") / F.col("n")
    spread = lambda q, s: F.col(q) - F.col(s) * F.col(s) / F.col("n")
    # What rounding leaves of a constant column is no spread.
    ok = (spread("qi", "si") > 1e-13 * F.col("qi")) & (spread("qj", "sj") > 1e-13 * F.col("qj"))
    r = F.when(F.col("i") == F.col("j"), F.when(ok, 1.0)).otherwise(F.when(ok, cov / F.sqrt(spread("qi", "si") * spread("qj", "sj"))))
    cells = sums.filter("i >= 0 and n > 0").select(*by, "i", "j", r.alias("r"))
    cells = cells.unionByName(cells.filter("i <> j").select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    rows = sums.filter("i < 0").select(*by, F.col("n"))
    # Pairs without a common row have no sums of their own.
    names = F.array(*[F.lit(c) for c in columns])
    grid = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))))
    on = [F.col(f"g.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by] + [F.col("g.i") == F.col("c.i"), F.col("g.j") == F.col("c.j")]
    joined = grid.alias("g").join(cells.alias("c"), on, "left")
    return joined.select(*[F.col(f"g.{c}").alias(c) for c in by], F.col("g.n").alias("n"), F.get(names, F.col("g.i")).alias("a"), F.get(names, F.col("g.j")).alias("b"), F.col("c.r").alias("r"))


def correlation_values(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """The k x k matrix on the driver, as decisions about columns need it."""
    if len(columns) < 2:
        return {}
    return {(x["a"], x["b"]): x["r"] for x in correlation_matrix(df, columns).collect()}


def high_pairs(matrix: DataFrame, columns: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """Pairs i < j with |r| above the threshold, strongest first."""
    place = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    return (
        matrix.filter((place[F.col("a")] < place[F.col("b")]) & (F.abs("r") > threshold))
        .select("a", "b", "r")
        .orderBy(F.abs("r").desc(), "a", "b")
    )


def correlation_by_label(df: DataFrame, columns: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Matrix among the members of each label and over all rows, with the number of members."""
    return _correlations(pair_sums(df, columns, labels=labels), list(columns), ["label"])


# --- scaling and PCA --------------------------------------------------------------------------------


def fit_scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column."""
    row = df.agg(
        *[
            F.struct(F.avg(as_column(c).cast("double")), F.stddev_pop(as_column(c).cast("double"))).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    return {c: (row[f"c{i}"][0], row[f"c{i}"][1]) for i, c in enumerate(columns)}


def scaled(column: str, fit: Mapping[str, tuple[float, float]]) -> Column:
    """(x - mean) / population std; a constant column gives 0."""
    mean, std = fit[column]
    x = as_column(column).cast("double")
    if mean is None:
        return F.lit(None).cast("double")
    return (x - F.lit(mean)) / F.lit(std if std else 1.0)


def scale(df: DataFrame, columns: Sequence[str], fit: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    fit = fit or fit_scaling(df, columns)
    return df.withColumns({c: scaled(c, fit) for c in columns})


@dataclass
class FittedPca:
    """Scaling and loadings; projecting a row is a plain expression."""

    columns: list[str]
    scaling: dict[str, tuple[float, float]]
    ratios: list[float]
    loadings: np.ndarray  # columns x components

    def coordinate(self, k: int) -> Column:
        out = F.lit(0.0)
        for i, c in enumerate(self.columns):
            out = out + scaled(c, self.scaling) * F.lit(float(self.loadings[i, k]))
        return out

    def project(self, df: DataFrame, components: int | None = None) -> DataFrame:
        n = len(self.ratios) if components is None else min(components, len(self.ratios))
        return df.withColumns({f"pc{k + 1}": self.coordinate(k) for k in range(n)})

    def variance(self, df: DataFrame) -> DataFrame:
        total = np.cumsum(self.ratios)
        rows = [(k + 1, float(r), float(total[k])) for k, r in enumerate(self.ratios)]
        return df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double")

    def loading_table(self, df: DataFrame) -> DataFrame:
        rows = [
            (k + 1, c, float(self.loadings[i, k])) for k in range(len(self.ratios)) for i, c in enumerate(self.columns)
        ]
        return df.sparkSession.createDataFrame(rows, "component int, feature string, loading double")


def fit_pca(df: DataFrame, columns: Sequence[str], k: int = 5) -> FittedPca | None:
    """PCA of the scaled complete rows, or None without such a row. Each component's largest loading is positive.

    The covariance of scaled columns is their correlation, so one scan gives scaling and matrix; only the
    columns x columns matrix is decomposed on the driver.
    """
    columns = list(columns)
    p = len(columns)
    rows = complete_cases(df.select(*[as_column(c).cast("double").alias(c) for c in columns]), columns)
    sums = {(r["i"], r["j"]): r for r in pair_sums(rows, columns).collect()}  # columns x columns
    n = sums[-1, -1]["n"] if sums else 0
    if not n:
        return None
    mean = [sums[i, i]["shift"] + sums[i, i]["si"] / n for i in range(p)]
    spread = [sums[i, i]["qi"] - sums[i, i]["si"] ** 2 / n for i in range(p)]
    std = [math.sqrt(v / n) if v > 1e-13 * sums[i, i]["qi"] else 0.0 for i, v in enumerate(spread)]
    matrix = np.diag([1.0 if v else 0.0 for v in std])
    for i in range(p):
        for j in range(i + 1, p):
            if std[i] and std[j]:
                r = sums[i, j]
                matrix[i, j] = matrix[j, i] = (r["c"] - r["si"] * r["sj"] / n) / n / (std[i] * std[j])
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][: min(k, p, n)]
    loadings = vectors[:, order]
    # Of equally large loadings the first column decides the sign.
    leading = (np.abs(loadings) >= np.abs(loadings).max(axis=0) - 1e-9).argmax(axis=0)
    signs = np.sign(loadings[leading, range(len(order))])
    total = float(np.trace(matrix))
    ratios = [float(max(values[i], 0.0) / total) if total else 0.0 for i in order]
    return FittedPca(columns, {c: (mean[i], std[i]) for i, c in enumerate(columns)}, ratios, loadings * signs)


def pca_points(df: DataFrame, fitted: FittedPca, keep: Sequence[str]) -> DataFrame:
    """PC1/PC2 per complete row with the kept columns."""
    return fitted.project(complete_cases(df, fitted.columns), 2).select(*keep, "pc1", "pc2")


# --- similarity inside a group ---------------------------------------------------------------------


def _similarity(df: DataFrame, columns: Sequence[str], fit, **groups) -> DataFrame:
    """Figures of the ordered pairs i != j of each group, exactly and without pairs.

    With unit rows u, S = sum(u), G = sum(u u') and m non-zero rows of n, the cosine has the mean
    (|S|^2 - m) / (n (n-1)) and the mean square (|G|^2 - m) / (n (n-1)); the squared distance has the mean
    2 (n sum(|z|^2) - |sum(z)|^2) / (n (n-1)). A task hands out these sums, so rows of a group never meet.
    """
    columns = list(columns)
    rows = complete_cases(df, columns)
    fit = fit or fit_scaling(rows, columns)
    z = scale(rows, columns, fit)

    def sums(x: np.ndarray) -> dict[tuple[int, int], float]:
        squares = (x * x).sum(1)
        length = np.sqrt(squares)
        u = np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0)
        gram, p = u.T @ u, x.shape[1]
        cells = {(i, j): gram[i, j] for i in range(p) for j in range(i, p)}
        cells |= {(i, -1): v for i, v in enumerate(u.sum(0))} | {(i, -2): v for i, v in enumerate(x.sum(0))}
        return cells | {(-1, 0): float(len(x)), (-1, 1): float((length > 0).sum()), (-1, 2): float(squares.sum())}

    parts = group_sums(z, columns, sums, "i int, j int, v double", **groups)
    names = [f.name for f in parts.schema.fields[:-3]]
    cells = parts.groupBy(*names, "i", "j").agg(F.sum("v").alias("v"))
    part = lambda test, value: F.coalesce(F.sum(F.when(F.expr(test), value)), F.lit(0.0))
    square = F.col("v") * F.col("v")
    wide = cells.groupBy(*names).agg(
        part("i = -1 and j = 0", F.col("v")).alias("n"), part("i = -1 and j = 1", F.col("v")).alias("m"), part("i = -1 and j = 2", F.col("v")).alias("zz"),
        part("j = -1", square).alias("s2"), part("j = -2", square).alias("z2"), part("i >= 0 and j >= 0", F.when(F.col("i") == F.col("j"), square).otherwise(2 * square)).alias("g2"),
    )
    pairs = F.col("n") * (F.col("n") - 1)
    wide = wide.withColumn("cosine_mean", ratio(F.col("s2") - F.col("m"), pairs))
    spread = ratio(F.col("g2") - F.col("m"), pairs) - F.col("cosine_mean") * F.col("cosine_mean")
    return wide.select(
        *names, F.col("n").cast("long").alias("n"), "cosine_mean", F.sqrt(F.greatest(spread, F.lit(0.0))).alias("cosine_std"),
        F.greatest(ratio(2 * (F.col("n") * F.col("zz") - F.col("z2")), pairs), F.lit(0.0)).alias("squared_distance_mean"),
    )


def cosine_similarity(df: DataFrame, label: str, columns: Sequence[str], fit: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Members, mean and population std of the cosine over the pairs of each group of two or more."""
    found = _similarity(df, columns, fit, by=[label]).withColumnRenamed(label, "label")
    return found.filter("n > 1").select("label", "n", "cosine_mean", "cosine_std")


def similarity_comparison(df: DataFrame, labels: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per label that has two members: exact cosine and mean squared distance side by side."""
    return _similarity(df, columns, None, labels=labels, overall=False).filter("n > 1")
