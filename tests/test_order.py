"""Exact order statistics: the distributed ways give what the plain ones give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelab.functions import order as o


@pytest.fixture(scope="module")
def values(spark):
    hot = F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(((F.col("id") * 7919) % 997).cast("double"))
    return spark.range(6000).select((F.col("id") % 2).alias("g"), hot.alias("x"), (F.col("id") % 17).cast("double").alias("y")).cache()


def test_bracketed_quantiles_equal_percentile(values):
    probs = [0.0, 0.1, 0.25, 0.333, 0.5, 0.9, 1.0]
    plain = o.exact_quantiles(values, ["x", "y"], probs, by=["g"]).orderBy("g", "column").collect()
    wide = o.exact_quantiles(values, ["x", "y"], probs, by=["g"], small=10, accuracy=100).orderBy("g", "column").collect()
    assert [r["column"] for r in plain] == [r["column"] for r in wide]
    for a, b in zip(plain, wide):
        assert a["q"] == pytest.approx(b["q"], abs=1e-9)


def test_bracketed_quantiles_keep_null_groups(spark):
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, F.lit("a")).alias("g"), F.col("id").cast("double").alias("x"))
    got = {r["g"]: r["q"] for r in o.exact_quantiles(df, ["x"], [0.5], by=["g"], small=10, accuracy=50).collect()}
    assert got == {"a": [199.0], None: [200.0]}


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_in_buckets(values, descending):
    counts = values.groupBy("g", "x").agg(F.count("*").alias("n"))
    one = o.running_sums(counts, "x", ["n"], by=["g"], descending=descending)
    many = o.running_sums(counts, "x", ["n"], by=["g"], descending=descending, rows_per_task=50)
    frame = lambda df: df.toPandas().sort_values(["g", "x"]).reset_index(drop=True)
    assert frame(one).equals(frame(many))


def test_stratified_rank_is_the_same_in_buckets_and_after_repartition(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2900, 1).otherwise(0).alias("label"))
    ranks = []
    for frame, bits in ((df, 0), (df, 6), (df.repartition(13), 6)):
        rows = o.stratified_rank(frame, "label", ["id"], bits=bits).collect()
        ranks.append({r["id"]: (r["_rank"], r["_size"]) for r in rows})
    assert ranks[0] == ranks[1] == ranks[2]
    assert sorted(r for r, n in ranks[0].values() if n == 100) == list(range(100))


@pytest.mark.parametrize("n", [1, 7, 127, 300])
@pytest.mark.parametrize("strict", [False, True])
def test_bucket_index(spark, n, strict):
    edges = [i * 0.1 for i in range(n)]
    xs = [-1.0, 0.0, 0.1, 0.25, 0.30000000000000004, n * 0.1, 1e9]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    got = {r["x"]: r["b"] for r in df.select("x", o.bucket_index(F.col("x"), edges, strict).alias("b")).collect()}
    side = "left" if strict else "right"
    for x in xs:
        assert got[x] == np.searchsorted(edges, x, side=side)
    assert got[None] is None


def test_keep_one(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "b", 1), (4, None, 1), (5, None, 1)]
    df = spark.createDataFrame(rows, "id int, k string, v int")
    ids = lambda keep: sorted(r["id"] for r in o.keep_one(df, ["k", "v"], ["id"], keep).collect())
    assert ids("first") == [1, 3, 4]
    assert ids("last") == [2, 3, 5]
    assert ids(False) == [3]
    with pytest.raises(ValueError):
        o.keep_one(df, ["k"], ["id"], "middle")
