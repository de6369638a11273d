"""Exact order statistics that never put one group into one task.

* ``running_sums``   prefix sums along an order, split into value buckets with carried offsets
* ``exact_quantiles``  linear-interpolated quantiles: one aggregate for small groups; for large
  ones an approximate sketch brackets the wanted ranks and only the bracket is ordered
* ``stratified_rank``  exact row rank inside a label along a hash, split into hash buckets
* ``bucket_index``   position of a value among fixed edges (binary search in the plan)
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hashing import HASH_BITS, row_hash
from .nulls import as_column

ROWS_PER_TASK = 500_000
MAX_BUCKETS = 10_000
SMALL_ROWS = 100_000
DISTINCT_PER_GROUP = 100_000
WHEN_TREE_LIMIT = 128


def bucket_index(value: Column, edges: Sequence[float], strict: bool = False) -> Column:
    """Number of edges <= value, or < value if ``strict`` (null for null). ``edges`` ascending, no duplicates."""
    edges = [float(e) for e in edges]

    def reached(edge: Column) -> Column:
        return value > edge if strict else value >= edge

    if len(edges) <= WHEN_TREE_LIMIT:
        def search(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(reached(F.lit(edges[mid])), search(mid + 1, hi)).otherwise(search(lo, mid))

        return F.when(value.isNotNull(), search(0, len(edges)))
    steps = F.lit(edges)
    lo = F.lit(0)
    # Binary search unrolled over a constant array: log2(n) small expressions instead of n.
    state = F.struct(lo.alias("lo"), F.lit(len(edges)).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        up = reached(F.get(steps, mid))
        done = acc["lo"] >= acc["hi"]
        return F.struct(
            F.when(~done & up, mid + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(~done & ~up, mid).otherwise(acc["hi"]).alias("hi"),
        )

    rounds = math.ceil(math.log2(len(edges) + 1))
    found = F.aggregate(F.lit(list(range(rounds))), state, halve)["lo"]
    return F.when(value.isNotNull(), found)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], small: int = 0, large: bool = False) -> DataFrame:
    """Inner join where null keys match. The right side is broadcast only if it has at most ``small`` rows.

    If it has more, or both sides are said to be ``large``, none is: the plan's guess of a size starts from compressed
    files and would send whole tables through the driver.
    """
    renamed = right.select(
        *[as_column(k).alias(f"_r_{k}") for k in keys], *[as_column(c) for c in right.columns if c not in keys]
    )
    if small and right.limit(small + 1).count() <= small:
        renamed = F.broadcast(renamed)
    elif small or large:
        renamed = renamed.hint("merge")
    on = F.lit(True)
    for k in keys:
        on = on & as_column(k).eqNullSafe(as_column(f"_r_{k}"))
    return left.join(renamed, on).drop(*[f"_r_{k}" for k in keys])


def score_edges(df: DataFrame, order: str, rows_per_task: int, rows: int | None = None) -> list[float]:
    """Edges that cut the rows of ``df`` into buckets of about ``rows_per_task`` rows."""
    rows = df.count() if rows is None or rows > rows_per_task else rows
    n = min(MAX_BUCKETS, math.ceil(rows / rows_per_task))
    if n <= 1:
        return []
    cuts = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(as_column(order).cast("double"), cuts, 10 * n)).first()
    return sorted(set(row[0] or []))


def running_sums(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
    spread: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Inclusive running sums ``cum_<c>`` and group totals ``total_<c>``.

    ``df`` holds one row per (by, order) value, already aggregated. Rows are bucketed by value; a
    window runs inside each bucket and the sums of the buckets before it are added. ``spread`` may
    name a cheaper frame with the order column (such as the rows before aggregation) to cut buckets
    from; a bucket then holds at most as many values of a group as rows. ``rows`` may bound the values
    of one group, which saves the count where they are few.
    """
    edges = score_edges(df if spread is None else spread, order, rows_per_task, rows)
    by = list(by)
    key = as_column(order)
    direction = key.desc() if descending else key.asc()
    if not edges:
        run = Window.partitionBy(*by).orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*by)
        return df.select(
            "*",
            *[F.sum(c).over(run).alias(f"cum_{c}") for c in sums],
            *[F.sum(c).over(whole).alias(f"total_{c}") for c in sums],
        )
    bucketed = df.withColumn("_bucket", bucket_index(key.cast("double"), edges))
    bucket_dir = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    before = Window.partitionBy(*by).orderBy(bucket_dir).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    # At most MAX_BUCKETS rows per group go through these windows.
    offsets = (
        bucketed.groupBy(*by, "_bucket")
        .agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
        .select(
            *by,
            "_bucket",
            *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums],
            *[F.sum(f"_sum_{c}").over(whole).alias(f"total_{c}") for c in sums],
        )
    )
    run = Window.partitionBy(*by, "_bucket").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    return null_safe_join(bucketed, offsets, [*by, "_bucket"], small=SMALL_ROWS).select(
        *[as_column(c) for c in df.columns],
        *[(F.sum(c).over(run) + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in sums],
        *[F.col(f"total_{c}") for c in sums],
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    small: int = DISTINCT_PER_GROUP,
    accuracy: int = 10_000,
) -> DataFrame:
    """Linear-interpolated quantiles of each column, one row per (by, column): ``q`` is the array.

    The exact ``percentile`` aggregate keeps a count per distinct value. It serves the columns whose
    distinct values, taken together, stay within about ``small`` in every group. For the others it
    would gather them all in one task, so their ranks are bracketed first.
    """
    by = list(by)
    columns = list(columns)
    probs = [float(p) for p in probs]
    sizes = df.groupBy(*by).agg(*[F.approx_count_distinct(as_column(c)).alias(f"_d{i}") for i, c in enumerate(columns)])
    most = sizes.agg(*[F.max(f"_d{i}").alias(f"_d{i}") for i in range(len(columns))]).first()
    few: list[str] = []
    held = 0
    for n, c in sorted((most[f"_d{i}"] or 0, c) for i, c in enumerate(columns)):
        held += n
        if held <= small:
            few.append(c)
    many = [c for c in columns if c not in few]
    parts = []
    if few:
        wide = df.groupBy(*by).agg(
            *[F.percentile(as_column(c).cast("double"), F.lit(probs)).alias(f"_q{i}") for i, c in enumerate(few)]
        )
        rows = [F.struct(F.lit(c).alias("column"), F.col(f"_q{i}").alias("q")) for i, c in enumerate(few)]
        parts.append(wide.select(*by, F.inline(F.array(*rows))))
    if many:
        parts.append(_bracketed_quantiles(df, many, probs, by, accuracy))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _bracketed_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], by: list[str], accuracy: int
) -> DataFrame:
    keys = [*by, "column"]
    margin = 2.0 / accuracy  # twice the rank error of the sketch
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), as_column(c).cast("double").alias("value")) for c in columns]
    )
    long = df.select(*by, F.inline(cells)).filter(F.col("value").isNotNull())
    lows = [max(0.0, p - margin) for p in probs]
    highs = [min(1.0, p + margin) for p in probs]
    # One row per (by, column): counts and the value bracket around each wanted rank.
    bounds = long.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.percentile_approx("value", lows, accuracy).alias("lo"),
        F.percentile_approx("value", highs, accuracy).alias("hi"),
        F.min("value").alias("vmin"),
        F.max("value").alias("vmax"),
    )
    lo = lambda i: F.when(F.lit(lows[i] == 0.0), F.col("vmin")).otherwise(F.col("lo")[i])
    hi = lambda i: F.when(F.lit(highs[i] == 1.0), F.col("vmax")).otherwise(F.col("hi")[i])
    bounds = bounds.select(
        *keys,
        "n",
        F.array(*[
            F.struct(
                F.lit(i).alias("i"),
                lo(i).alias("lo"),
                hi(i).alias("hi"),
                (F.col("n") - 1).cast("double").__mul__(F.lit(p)).alias("rank"),
            )
            for i, p in enumerate(probs)
        ]).alias("brackets"),
    )
    bounds = _written_once(bounds)
    largest = bounds.agg(F.max("n")).first()[0] or 0
    joined = null_safe_join(long, bounds, keys, small=SMALL_ROWS).withColumn("b", F.explode("brackets"))
    # Values under the bracket are counted together as -inf, those above it do not matter.
    value = F.when(F.col("value") < F.col("b.lo"), F.lit(float("-inf"))).otherwise(F.col("value"))
    inside = (
        joined.filter(F.col("value") <= F.col("b.hi"))
        .select(*keys, F.col("b.i").alias("i"), F.col("b.rank").alias("rank"), value.alias("value"))
        .groupBy(*keys, "i", "value")
        .agg(F.count("*").alias("n_value"), F.first("rank").alias("rank"))
    )
    running = running_sums(inside, "value", ["n_value"], by=[*keys, "i"], rows=int(largest * 6 / accuracy) + 2)
    at = (
        running.withColumn("last", F.col("cum_n_value") - 1)
        .withColumn("first", F.col("cum_n_value") - F.col("n_value"))
        .groupBy(*keys, "i")
        .agg(
            F.max(F.when(F.floor("rank").between(F.col("first"), F.col("last")), F.col("value"))).alias("v_lo"),
            F.max(F.when(F.ceil("rank").between(F.col("first"), F.col("last")), F.col("value"))).alias("v_hi"),
            F.first("rank").alias("rank"),
        )
        .withColumn("v", F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (F.col("rank") - F.floor("rank")))
    )
    # The sketch's error bound keeps every rank inside its bracket; anything else must not pass as a result.
    lost = F.coalesce(F.least("v_lo", "v_hi") == float("-inf"), F.lit(False)) | F.col("v_lo").isNull() | F.col("v_hi").isNull()
    at = at.withColumn("v", F.when(lost, F.raise_error("a quantile fell outside its bracket").cast("double")).otherwise(F.col("v")))
    ordered = F.array_sort(F.collect_list(F.struct("i", "v")))
    return at.groupBy(*keys).agg(F.transform(ordered, lambda s: s["v"]).alias("q"))


def _written_once(small: DataFrame) -> DataFrame:
    """Fix a one-row-per-group table so that every later use sees the same values."""
    from ..session import checkpointed

    return checkpointed(small)


def quantile_values(df: DataFrame, columns: Sequence[str], probs: Sequence[float], **kw) -> dict[str, list[float] | None]:
    """``exact_quantiles`` without groups, as a driver-side dict (one short list per column)."""
    return {r["column"]: r["q"] for r in exact_quantiles(df, columns, probs, **kw).collect()}


#: Hash buckets in which a ranking counts its rows first; they are merged to buckets of a task's size.
FINE_BITS = 16


def stratified_rank(
    df: DataFrame,
    label: str,
    keys: Sequence[str],
    seed: int = 42,
    method: str = "xxhash64",
    bits: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``_rank`` (0-based, by hash inside the label) and ``_size`` (rows of the label).

    The hash is uniform, so its leading bits cut even one dominating label into equal buckets;
    ranks are taken inside a bucket and shifted by the sizes of the buckets before it. One pass counts rows by
    label and fine bucket, which gives the number of buckets, the offsets and the sizes; a second one ranks.
    """
    h = df.withColumn("_hash", row_hash(keys, seed, method))
    fine = F.shiftright("_hash", HASH_BITS - FINE_BITS).cast("int")
    counted = _written_once(h.groupBy(label, fine.alias("_fine")).agg(F.count("*").alias("_n")))
    if bits is None:
        rows = counted.agg(F.sum("_n")).first()[0] or 0
        bits = min(FINE_BITS, max(0, math.ceil(math.log2(max(1, rows) / rows_per_task))))
    h = h.withColumn("_bucket", F.shiftright(fine, FINE_BITS - bits) if bits else F.lit(0))
    before = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        counted.groupBy(label, (F.shiftright("_fine", FINE_BITS - bits) if bits else F.lit(0)).alias("_bucket"))
        .agg(F.sum("_n").alias("_n"))
        .select(
            label,
            "_bucket",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
            F.sum("_n").over(Window.partitionBy(label)).alias("_size"),
        )
    )
    inside = Window.partitionBy(label, "_bucket").orderBy("_hash", *keys)
    ranked = h.withColumn("_in", F.row_number().over(inside) - 1)
    return null_safe_join(ranked, sizes, [label, "_bucket"], small=SMALL_ROWS).select(
        *[as_column(c) for c in df.columns], (F.col("_in") + F.col("_offset")).cast("long").alias("_rank"), "_size"
    )


def keep_one(
    df: DataFrame, subset: Sequence[str], order: Sequence[str], keep: str | bool = "first"
) -> DataFrame:
    """One row per distinct ``subset`` value (nulls equal): the first or last along ``order``.

    A min/max aggregate over the row combines on the map side, so a value with very many copies
    costs no more than any other. ``keep=False`` drops every value that has copies.
    """
    names = df.columns
    row = F.struct(*[as_column(c) for c in names])
    position = F.struct(*[as_column(c) for c in order])
    grouped = df.groupBy(*[as_column(c) for c in subset])
    if keep == "first":
        best = grouped.agg(F.min_by(row, position).alias("_row"))
    elif keep == "last":
        best = grouped.agg(F.max_by(row, position).alias("_row"))
    elif keep is False:
        best = grouped.agg(F.min_by(row, position).alias("_row"), F.count("*").alias("_copies"))
        best = best.filter(F.col("_copies") == 1)
    else:
        raise ValueError(f"keep must be 'first', 'last' or False, not {keep!r}")
    return best.select(*[F.col("_row")[c].alias(c) for c in names])
