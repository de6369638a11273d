"""Value counts: one (column, value, n) table as the shared source of a table's column figures.

The table is counted in one scan that combines on the map side and is written once. Distinct values, the most
frequent value's share, constancy, extremes, moments and quantiles are small aggregates over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import as_column, coerce, is_floating, is_numeric, ratio
from ..functions.order import running_sums
from ..session import checkpointed


def _written(field: T.StructField) -> Column:
    """A text that tells the values of a column apart; both zeros are one value, as are all NaN."""
    c = as_column(field.name)
    if is_floating(field.dataType):
        return (c + 0.0).cast("string")
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(c)
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, coerced: bool = False, read_text: bool = False) -> DataFrame:
    """(column, value, number, n) of every value, nulls included; ``number`` is null for what is not a number.

    With ``coerced`` the values are the numbers that texts are read as, and all others count as null. With
    ``read_text`` the values stay, and ``number`` is what a text is read as.
    """
    cells = []
    for name in columns or df.columns:
        field = df.schema[name]
        if coerced:
            number = coerce(df, name) + 0.0
            value = number.cast("string")
        else:
            value = _written(field)
            number = F.lit(None).cast("double")
            if is_numeric(field.dataType):
                number = as_column(name).cast("double") + 0.0
            elif read_text and isinstance(field.dataType, T.StringType):
                number = coerce(df, name) + 0.0
        cells.append(F.struct(F.lit(name).alias("column"), value.alias("value"), number.alias("number")))
    return checkpointed(df.select(F.inline(F.array(*cells))).groupBy("column", "value", "number").agg(F.count("*").alias("n")))


def column_figures(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per listed column: rows, values, distinct values, share of the most frequent, extremes, mean and sample std."""
    spark = counts.sparkSession
    numbers = F.when(F.col("number").isNotNull(), F.col("n"))
    first = counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("non_null"),
        F.count("value").alias("n_distinct"),
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("_top"),
        F.sum(numbers).alias("_numbers"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        ratio(F.sum(F.col("number") * F.col("n")), F.sum(numbers)).alias("mean"),
    )
    away = F.col("number") - F.col("mean")
    second = counts.join(F.broadcast(first.select("column", "mean")), "column").groupBy("column").agg(F.sum(away * away * F.col("n")).alias("_squares"))
    listed = spark.createDataFrame([(c,) for c in columns], "column string")
    table = listed.join(F.broadcast(first), "column", "left").join(F.broadcast(second), "column", "left")
    n = F.coalesce("n_rows", F.lit(0))
    values = F.coalesce("non_null", F.lit(0))
    return table.select(
        "column", n.alias("n_rows"), values.alias("non_null"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        ratio(F.col("_top"), F.col("non_null")).alias("top_share"), "min", "max", "mean",
        F.sqrt(F.when(F.col("_numbers") > 1, F.col("_squares") / (F.col("_numbers") - 1))).alias("std"),
    )


def quantiles(counts: DataFrame, probs: Sequence[float], by: Sequence[str] = ("column",), rows: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles of the numbers of each group: ``q`` is the array; groups without numbers are absent.

    ``rows`` is a bound of the values of one group; by default the rows of ``counts``.
    """
    by = list(by)
    rows = counts.count() if rows is None else rows
    numbers = counts.filter(F.col("number").isNotNull()).groupBy(*by, "number").agg(F.sum("n").alias("n"))
    run = running_sums(numbers, "number", ["n"], by=by, rows=rows)
    last, before = F.col("cum_n") - 1, F.col("cum_n") - F.col("n")
    ranks = [(F.col("total_n") - 1).cast("double") * F.lit(float(p)) for p in probs]
    at = lambda place: F.max(F.when(place.between(before, last), F.col("number")))
    found = run.groupBy(*by).agg(
        F.max("total_n").alias("total_n"),
        *[at(F.floor(r)).alias(f"_lo{i}") for i, r in enumerate(ranks)],
        *[at(F.ceil(r)).alias(f"_hi{i}") for i, r in enumerate(ranks)],
    )
    q = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (r - F.floor(r)) for i, r in enumerate(ranks)]
    return found.select(*by, F.array(*q).alias("q"))


def constant_columns(counts: DataFrame) -> list[str]:
    """Columns with at most one value."""
    held = counts.groupBy("column").agg(F.count("value").alias("n"))
    return sorted(r["column"] for r in held.filter("n <= 1").collect())  # one row per column


def top_shares(counts: DataFrame) -> DataFrame:
    """Share of the most frequent value among the values of each column that has some."""
    held = counts.filter(F.col("value").isNotNull())
    return held.groupBy("column").agg(ratio(F.max("n"), F.sum("n")).alias("top_share"))
