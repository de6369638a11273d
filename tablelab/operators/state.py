"""Fits that keep up with a growing table: small tables that add up, instead of reading old files again.

A ``FitState`` holds value counts of the columns and moments of the pairs of number columns of the rows seen so far.
The states of two sets of rows add up to the state of both, and the fits of cleaning and of derived columns are read
from a state: missing shares, constant columns, outlier bounds, scales, bin edges, whole numbers, correlations.
A folder of states has one part per batch; writing a batch again replaces its part, so a repeated batch counts once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.moments import pair_sums
from ..functions.nulls import coerce, ratio
from ..session import checkpointed
from .clean import correlated_columns
from .features import equal_frequency_edges, equal_width_edges
from .values import column_figures, constant_columns, quantiles, top_shares, value_counts

VALUES = "column string, value string, number double, n long"
#: Of the rows that are complete in a pair: their number, both means, both sums of squares and of products about them.
PAIRS = "a string, b string, n long, mean_a double, mean_b double, square_a double, square_b double, product double"


def _pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    numbers = df.select(*[coerce(df, c).alias(c) for c in columns])
    sums = checkpointed(pair_sums(numbers, columns).filter("i >= 0 AND n > 0"))
    shifts = {r["i"]: r["shift"] for r in sums.filter("i = j").select("i", "shift").collect()}  # one row per column
    shift = F.lit([float(shifts.get(i) or 0.0) for i in range(len(columns))])
    names = F.lit(list(columns))
    return sums.select(
        F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "n",
        (F.get(shift, F.col("i")) + F.col("si") / F.col("n")).alias("mean_a"), (F.get(shift, F.col("j")) + F.col("sj") / F.col("n")).alias("mean_b"),
        (F.col("qi") - F.col("si") * F.col("si") / F.col("n")).alias("square_a"), (F.col("qj") - F.col("sj") * F.col("sj") / F.col("n")).alias("square_b"),
        (F.col("c") - F.col("si") * F.col("sj") / F.col("n")).alias("product"),
    )


def _added_values(parts: DataFrame) -> DataFrame:
    return parts.groupBy("column", "value", "number").agg(F.sum("n").cast("long").alias("n"))


def _added_pairs(parts: DataFrame) -> DataFrame:
    """Moments of all parts: those of each part about its own means, and the parts' means about the common ones."""
    weighted = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    means = parts.groupBy("a", "b").agg(weighted("mean_a").alias("_a"), weighted("mean_b").alias("_b"))
    away_a, away_b = F.col("mean_a") - F.col("_a"), F.col("mean_b") - F.col("_b")
    n = F.col("n")
    return parts.join(means, ["a", "b"]).groupBy("a", "b").agg(
        F.sum("n").cast("long").alias("n"), F.first("_a").alias("mean_a"), F.first("_b").alias("mean_b"),
        F.sum(F.col("square_a") + n * away_a * away_a).alias("square_a"), F.sum(F.col("square_b") + n * away_b * away_b).alias("square_b"),
        F.sum(F.col("product") + n * away_a * away_b).alias("product"),
    )


@dataclass(frozen=True)
class FitState:
    values: DataFrame
    pairs: DataFrame

    # --- making and adding ------------------------------------------------------------------------------

    @staticmethod
    def of(df: DataFrame, columns: Sequence[str] | None = None, paired: Sequence[str] = ()) -> FitState:
        """The state of the rows of ``df``; ``paired`` are the number columns whose correlations will be asked for."""
        spark = df.sparkSession
        values = value_counts(df, columns, read_text=True)
        return FitState(values, checkpointed(_pair_moments(df, paired)) if paired else spark.createDataFrame([], PAIRS))

    @staticmethod
    def merged(states: Sequence[FitState]) -> FitState:
        values = reduce(DataFrame.unionByName, [s.values for s in states])
        pairs = reduce(DataFrame.unionByName, [s.pairs for s in states])
        return FitState(checkpointed(_added_values(values)), checkpointed(_added_pairs(pairs)))

    def write(self, folder: str, batch: int | str) -> None:
        """Store as the part of one batch; an earlier part of that batch is replaced."""
        for name, table in (("values", self.values), ("pairs", self.pairs)):
            table.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}/batch={batch}")

    @staticmethod
    def read(spark: SparkSession, folder: str) -> FitState:
        """The sum of all stored parts."""
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{name}")
        names = lambda schema: [c.split()[0] for c in schema.split(", ")]
        values, pairs = read("values", VALUES).select(*names(VALUES)), read("pairs", PAIRS).select(*names(PAIRS))
        return FitState(checkpointed(_added_values(values)), checkpointed(_added_pairs(pairs)))

    # --- fits -------------------------------------------------------------------------------------------

    def columns(self) -> list[str]:
        return sorted(r[0] for r in self.values.select("column").distinct().collect())

    def figures(self, columns: Sequence[str] | None = None) -> dict[str, dict]:
        """Rows, values, distinct values, most frequent share, extremes, mean and sample std by column."""
        return {r["column"]: r.asDict() for r in column_figures(self.values, columns or self.columns()).collect()}

    def high_missing(self, threshold: float = 0.9) -> dict[str, float]:
        """Columns whose null share is above the threshold, with the share."""
        shares = {c: (f["n_rows"] - f["non_null"]) / f["n_rows"] if f["n_rows"] else 0.0 for c, f in self.figures().items()}
        return {c: s for c, s in shares.items() if s > threshold}

    def constant(self) -> list[str]:
        return constant_columns(self.values)

    def quasi_constant(self, threshold: float = 0.99) -> dict[str, float]:
        return {r["column"]: r["top_share"] for r in top_shares(self.values).filter(F.col("top_share") >= threshold).collect()}

    def quantiles(self, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
        own = self.values.filter(F.col("column").isin(list(columns)))
        return {r["column"]: r["q"] for r in quantiles(own, probs).collect()}

    def outlier_bounds(self, columns: Sequence[str], method: str = "iqr", multiplier: float = 3.0) -> dict[str, tuple[float, float]]:
        """Bounds as of ``clean.fit_outlier_bounds``."""
        if method == "iqr":
            found = self.quantiles(columns, [0.25, 0.75])
            return {c: (q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)) for c, (q1, q3) in found.items()}
        if method == "zscore":
            figures = self.figures(columns)
            return {c: (f["mean"] - multiplier * f["std"], f["mean"] + multiplier * f["std"]) for c, f in figures.items() if f["std"] is not None}
        return {}

    def scales(self, columns: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
        """Mean and sample std, as standardising takes them."""
        return {c: (f["mean"], f["std"]) for c, f in self.figures(columns).items()}

    def ranges(self, columns: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
        """Least and largest number, as normalising takes them."""
        return {c: (f["min"], f["max"]) for c, f in self.figures(columns).items()}

    def bin_edges(self, column: str, bins: int, method: str = "equal_width") -> list[float]:
        if method == "equal_width":
            lo, hi = self.ranges([column])[column]
            return equal_width_edges(lo, hi, bins)
        return equal_frequency_edges(self.quantiles([column], [i / bins for i in range(bins + 1)])[column])

    def whole(self, columns: Sequence[str]) -> list[str]:
        """Columns without a fractional number."""
        broken = self.values.filter(F.col("column").isin(list(columns)) & (F.col("number") != F.floor("number")))
        found = {r[0] for r in broken.select("column").distinct().collect()}
        return [c for c in columns if c not in found]

    def correlations(self) -> DataFrame:
        """(a, b, r) of the paired columns, both ways round; r is null for a constant column."""
        spread = lambda s, m: F.col(s) > 1e-13 * (F.col(s) + F.col("n") * F.col(m) * F.col(m))
        ok = spread("square_a", "mean_a") & spread("square_b", "mean_b")
        r = F.when(ok, ratio(F.col("product"), F.sqrt(F.col("square_a") * F.col("square_b"))))
        upper = self.pairs.select("a", "b", F.when(F.col("a") == F.col("b"), F.when(ok, 1.0)).otherwise(r).alias("r"))
        return upper.unionByName(upper.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))

    def correlated(self, columns: Sequence[str], threshold: float = 0.95) -> list[str]:
        """Columns to drop, as of ``clean.fit_correlated``."""
        return correlated_columns(list(columns), {(x["a"], x["b"]): x["r"] for x in self.correlations().collect()}, threshold)


def keep_state(arriving: DataFrame, folder: str, checkpoint: str, columns: Sequence[str] | None = None, paired: Sequence[str] = ()) -> StreamingQuery:
    """Add the state of each arriving batch to the folder and stop when all that has arrived is in it."""

    def add(batch: DataFrame, number: int) -> None:
        FitState.of(batch, columns, paired).write(folder, number)

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
