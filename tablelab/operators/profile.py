"""Profiles of wide tables: statistics, missing values, label breakdowns, histograms, distributions."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.groups import set_labels, to_long
from ..functions.nulls import as_column, coerce, is_numeric, ratio
from ..functions.order import bucket_index, exact_quantiles, null_safe_join
from ..session import checkpointed
from .features import z_score
from .labeling import combination, unpivot
from .values import column_figures, quantiles, value_counts


def column_statistics(df: DataFrame, approximate_distinct: bool = False) -> DataFrame:
    """Per column: type, non-null, null, null %, distinct; for numbers also min, max, mean, median, std.

    All figures come from one table of value counts. With ``approximate_distinct`` no value travels: distinct values
    are estimated and the others are one aggregate.
    """
    kinds = F.lit([f.dataType.simpleString() for f in df.schema.fields])
    numbers = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    if approximate_distinct:
        return _approximate_statistics(df, numbers)
    counts = value_counts(df)
    medians = quantiles(counts, [0.5]).select("column", F.col("q")[0].alias("median"))
    table = column_figures(counts, df.columns).join(F.broadcast(medians), "column", "left")
    place = F.array_position(F.lit(df.columns), F.col("column")).cast("int")
    nulls = F.col("n_rows") - F.col("non_null")
    return table.select(
        "column", F.get(kinds, place - 1).alias("dtype"), "non_null", nulls.alias("nulls"), ratio(nulls * 100, F.col("n_rows")).alias("null_pct"),
        "n_distinct", "min", "max", "mean", "std", "median",
    )


def _approximate_statistics(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    aggs: list[Column] = [F.count("*").alias("n")]
    per: dict[str, dict[str, Column]] = {}
    nothing = F.lit(None).cast("double")
    for i, f in enumerate(df.schema.fields):
        c = as_column(f.name)
        aggs += [F.count(c).alias(f"c{i}"), F.approx_count_distinct(c).alias(f"d{i}")]
        if f.name in numbers:
            v = c.cast("double")
            aggs += [
                F.struct(F.min(v), F.max(v), F.avg(v), F.stddev_samp(v)).alias(f"s{i}"),
            ]
        stats = [F.col(f"s{i}")[f"col{k}"] if f.name in numbers else nothing for k in (1, 2, 3, 4)]
        per[f.name] = {
            "dtype": F.lit(f.dataType.simpleString()),
            "non_null": F.col(f"c{i}"),
            "nulls": F.col("n") - F.col(f"c{i}"),
            "null_pct": ratio((F.col("n") - F.col(f"c{i}")) * 100, F.col("n")),
            "n_distinct": F.col(f"d{i}"),
            "min": stats[0],
            "max": stats[1],
            "mean": stats[2],
            "std": stats[3],
        }
    table = to_long(df.agg(*aggs), [], per)
    if not numbers:
        return table.withColumn("median", nothing)
    medians = exact_quantiles(df, numbers, [0.5]).select("column", F.col("q")[0].alias("median"))
    return table.join(medians, "column", "left")


def feature_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: count, missing, missing %, mean, std, min, max and quartiles of the coerced values."""
    counts = value_counts(df, columns, coerced=True)
    q = quantiles(counts, [0.25, 0.5, 0.75]).select(
        "column", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75")
    )
    missing = F.col("n_rows") - F.col("non_null")
    table = column_figures(counts, columns).select(
        "column", F.col("non_null").alias("count"), missing.alias("missing"), ratio(missing * 100, F.col("n_rows")).alias("missing_pct"),
        "mean", "std", "min", "max",
    )
    return table.join(F.broadcast(q), "column", "left")


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing count and % per column, fewest first."""
    wide = df.agg(F.count("*").alias("n"), *[F.count(as_column(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    per = {
        c: {
            "missing": F.col("n") - F.col(f"c{i}"),
            "missing_pct": ratio((F.col("n") - F.col(f"c{i}")) * 100, F.col("n")),
        }
        for i, c in enumerate(df.columns)
    }
    return to_long(wide, [], per).orderBy("missing", "column")


def statistics_by_label(df: DataFrame, columns: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Per feature and label (and 'overall'): count, mean, std (0 for one value), min, max, median.

    Rows are read once and counted by label combination and value; the counts are added up to labels, so no row is
    copied for the labels that it has.
    """
    combination = F.array_sort(set_labels(labels, overall=True))
    cells = [F.struct(F.lit(c).alias("column"), (coerce(df, c) + 0.0).alias("number")) for c in columns]
    counts = df.select(combination.alias("_labels"), F.inline(F.array(*cells))).filter(F.col("number").isNotNull())
    counts = checkpointed(counts.groupBy("_labels", "column", "number").agg(F.count("*").alias("n")))
    # Sums by combination first: there are few combinations, and their moments add up.
    of = counts.groupBy("_labels", "column").agg(
        F.sum("n").alias("n"), (F.sum(F.col("number") * F.col("n")) / F.sum("n")).alias("mean"), F.min("number").alias("min"), F.max("number").alias("max")
    )
    away = F.col("number") - F.col("mean")
    joined = counts.join(F.broadcast(of.select("_labels", "column", "mean")), ["_labels", "column"])
    squares = joined.groupBy("_labels", "column").agg(F.sum(away * away * F.col("n")).alias("squares"))
    parts = of.join(squares, ["_labels", "column"]).withColumn("label", F.explode("_labels"))
    whole = Window.partitionBy("label", "column")
    parts = parts.withColumn("_mean", F.sum(F.col("mean") * F.col("n")).over(whole) / F.sum("n").over(whole))
    apart = F.col("mean") - F.col("_mean")
    table = parts.groupBy("label", "column").agg(
        F.sum("n").alias("count"), F.first("_mean").alias("mean"),
        F.coalesce(F.sqrt(F.try_divide(F.sum(F.col("squares") + F.col("n") * apart * apart), F.sum("n") - 1)), F.lit(0.0)).alias("std"),
        F.min("min").alias("min"), F.max("max").alias("max"),
    )
    by_label = counts.select(F.explode("_labels").alias("label"), "column", "number", "n")
    medians = quantiles(by_label, [0.5], by=["label", "column"], rows=counts.count()).select("label", "column", F.col("q")[0].alias("median"))
    return table.join(medians, ["label", "column"], "left")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(as_column(label).alias("value")).agg(F.count("*").alias("n"))


def trainable(balance: dict, minimum: int = 5) -> str | None:
    """Why a label cannot be trained (fewer than two classes, or a class below the minimum), or None."""
    if len(balance) < 2:
        return "only one class"
    if min(balance.values()) < minimum:
        return f"smallest class below {minimum}"
    return None


def label_shares(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Members and mean share (%) of each label."""
    wide = df.agg(
        *[F.sum(as_column(n)).alias(f"s{i}") for i, n in enumerate(labels)],
        *[F.avg(as_column(n)).alias(f"m{i}") for i, n in enumerate(labels)],
    )
    return to_long(
        wide, [], {n: {"n": F.col(f"s{i}"), "percent": F.col(f"m{i}") * 100} for i, n in enumerate(labels)}, "label"
    )


# --- histograms ------------------------------------------------------------------------------------


def histogram_edges(lo: float, hi: float, bins: int) -> list[float]:
    """Equal-width edges; a single value gets a range of one around it."""
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return [lo + i * ((hi - lo) / bins) for i in range(bins)] + [hi]


def _bin(value: Column, edges: Sequence[float]) -> Column:
    """0-based bin, right-closed only at the last edge; null outside."""
    inside = value.between(F.lit(float(edges[0])), F.lit(float(edges[-1])))
    return F.when(inside, bucket_index(value, edges[1:-1]))


#: Ranges (one row per group and feature) up to this number are sent to all tasks; beyond it they are joined by key.
SMALL_RANGES = 100_000


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 50, groups: Sequence[str] = ()) -> DataFrame:
    """(feature, bin, lo, hi, n) with empty bins; with ``groups``, each group of a feature has its own range.

    Two passes: ranges, which stay a table, then counts that combine on the map side to at most ``bins`` rows per
    range. A value finds its bin by arithmetic and is compared with the edges beside it, so edges are exact.
    """
    groups = list(groups)
    values = df.select(*[as_column(g) for g in groups], *[coerce(df, c).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), as_column(c).alias("_value")) for c in columns])
    keys = [*groups, "feature"]
    spans = values.groupBy(*[as_column(g) for g in groups]).agg(
        *[F.struct(F.lit(c).alias("feature"), F.min(as_column(c)).alias("_low"), F.max(as_column(c)).alias("_high")).alias(f"_s{i}") for i, c in enumerate(columns)]
    )
    spans = spans.select(*[as_column(g) for g in groups], F.inline(F.array(*[f"_s{i}" for i in range(len(columns))]))).filter(F.col("_low").isNotNull())
    single = F.col("_low") == F.col("_high")
    ranges = checkpointed(
        spans.select(*keys, F.when(single, F.col("_low") - 0.5).otherwise(F.col("_low")).alias("_lo"), F.when(single, F.col("_high") + 0.5).otherwise(F.col("_high")).alias("_hi"))
    )
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))

    def edge(k: Column) -> Column:
        return F.when(k >= bins, F.col("_hi")).otherwise(F.col("_lo") + k * width)

    long = values.select(*[as_column(g) for g in groups], F.inline(cells)).filter(F.col("_value").isNotNull())
    guess = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("_value") - F.col("_lo")) / width))).cast("int")
    placed = null_safe_join(long, ranges, keys, small=SMALL_RANGES).withColumn("_k", guess)
    k = F.col("_k")
    exact = (
        F.when((k > 0) & (F.col("_value") < edge(k)), k - 1)
        .when((k < bins - 1) & (F.col("_value") >= edge(k + 1)), k + 1)
        .otherwise(k)
    )
    counted = placed.groupBy(*keys, exact.alias("bin")).agg(F.count("*").alias("n"))
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    grid = grid.select(*keys, "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"))
    counted = counted.select(*[as_column(c).alias(f"_c_{c}") for c in [*keys, "bin"]], "n")
    same = reduce(operator.and_, [as_column(c).eqNullSafe(as_column(f"_c_{c}")) for c in [*keys, "bin"]])
    return grid.join(counted, same, "left").select(*keys, "bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


# Range and bin count of the log10 histogram by provenance, and the floor before the log.
LOG_RANGE = (-1.2, 3.6)
LOG_BINS = 19
LOG_FLOOR = 0.05


def log_histogram(df: DataFrame, value: str, group: str) -> DataFrame:
    """Counts of log10(max(x, 0.05)) per bin and provenance, over fixed edges; empty bins are left out."""
    lo, hi = LOG_RANGE
    edges = [lo + i * ((hi - lo) / LOG_BINS) for i in range(LOG_BINS)] + [hi]
    x = F.log10(F.when(as_column(value) < LOG_FLOOR, F.lit(LOG_FLOOR)).otherwise(as_column(value)))
    return (
        df.filter(as_column(value).isNotNull())
        .select(as_column(group).alias("origin"), _bin(x, edges).alias("bin"))
        .filter(F.col("bin").isNotNull())
        .groupBy("origin", "bin")
        .agg(F.count("*").alias("n"))
    )


# --- distributions ----------------------------------------------------------------------------------


def distribution_by_combination(df: DataFrame, columns: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Five-number summary of each feature per label combination, with the number of values."""
    values = df.select(combination(labels).alias("domain"), *[coerce(df, c).alias(c) for c in columns])
    aggs = [
        F.struct(F.count(as_column(c)), F.min(as_column(c)), F.max(as_column(c))).alias(f"s{i}")
        for i, c in enumerate(columns)
    ]
    per = {
        c: {"count": F.col(f"s{i}.col1"), "min": F.col(f"s{i}.col2"), "max": F.col(f"s{i}.col3")}
        for i, c in enumerate(columns)
    }
    table = to_long(values.groupBy("domain").agg(*aggs), ["domain"], per).filter(F.col("count") > 0)
    q = exact_quantiles(values, columns, [0.25, 0.5, 0.75], by=["domain"]).select(
        "domain", "column", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75")
    )
    return table.join(q, ["domain", "column"])


def normalised_long(df: DataFrame, columns: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """z-scores of the features in long form, with the label combination of the row."""
    columns = list(columns)
    values = df.select(combination(labels).alias("domain"), *[coerce(df, c).alias(c) for c in columns])
    row = values.agg(
        *[F.struct(F.avg(as_column(c)), F.stddev_samp(as_column(c))).alias(c) for c in columns]
    ).first()
    z = values.select("domain", *[z_score(as_column(c), row[c][0], row[c][1]).alias(c) for c in columns])
    return unpivot(z, ["domain"], columns)


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value over all rows, per column."""
    wide = df.agg(F.count("*").alias("n"), *[F.count(as_column(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    return to_long(wide, [], {c: {"with_value": F.col(f"c{i}"), "n_rows": F.col("n")} for i, c in enumerate(columns)}, "endpoint")


# Fixed value: note of a pair whose primary value is missing.
ONLY_FALLBACK = "lab@20C MISSING - only typical available"


def value_pairs(df: DataFrame, key: str, primary: str, fallback: str, note: str = ONLY_FALLBACK) -> DataFrame:
    """Both measurements, their difference (3 places) and a note when only the fallback exists."""
    a, b = as_column(primary), as_column(fallback)
    return df.select(
        key,
        a.alias("primary"),
        b.alias("fallback"),
        F.round(a - b, 3).alias("diff"),
        F.when(a.isNull() & b.isNotNull(), F.lit(note)).alias("note"),
    )


def region(flags: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """Name of the first flag that is set."""
    out = None
    for column, name in flags:
        out = (F if out is None else out).when(as_column(column) == 1, F.lit(name))
    return F.lit(other) if out is None else out.otherwise(F.lit(other))
