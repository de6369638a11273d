"""Extraction works on tasks of a bounded number of texts, and large joins send nothing through the driver."""

from pyspark.sql import functions as F

from tablelab.functions.order import null_safe_join
from tablelab.operators import extract as ex


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_one_file_are_spread(spark, monkeypatch):
    df = spark.range(40).select(F.when(F.col("id") < 30, F.col("id")).alias("doc"), F.concat(F.lit("Koc ("), F.col("id").cast("string"), F.lit(") 7")).alias("text")).coalesce(1)
    found = lambda: sorted(map(tuple, ex.extract(df, "doc", "text", [ex.Endpoint("Koc", "same_line", r"Koc \(\d+\)")]).collect()), key=str)
    whole = found()
    monkeypatch.setattr(ex, "TEXTS_PER_TASK", 10)
    spread = ex._spread(df, "doc", "text", None)
    assert spread.rdd.getNumPartitions() == 4
    assert max(spread.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 30
    assert len(whole) == 31 and found() == whole


def test_joins_of_large_sides_do_not_broadcast(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "k int, x string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "k int, y string")
    for joined in (null_safe_join(a, b, ["k"], large=True), null_safe_join(a, b, ["k"], small=2)):
        assert "Broadcast" not in plan(joined)
        assert {tuple(r) for r in joined.collect()} == {(1, "a", "p"), (None, "b", "q"), (None, "c", "q")}
    assert "BroadcastHashJoin" in plan(null_safe_join(a, b, ["k"], small=3))
