"""Fits of merged states equal the fits of all rows."""

import pytest
from pyspark.sql import functions as F

from tablelab.operators import clean, stats
from tablelab.operators import profile as pr
from tablelab.operators.state import FitState, keep_state
from tablelab.operators.values import column_figures, quantiles, value_counts

COLUMNS = ["x", "y", "text", "one", "mostly", "gone", "key"]


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(500).select(
        "id",
        F.when(i % 7 != 0, (i * 37 % 101).cast("double") + 1e9).alias("x"),
        F.when(i % 5 != 0, (i * 37 % 101).cast("double") * -2 + (i % 3)).alias("y"),
        F.when(i % 4 == 0, "n/a").otherwise((i % 13).cast("string")).alias("text"),
        F.lit(5.0).alias("one"),
        F.when(i == 3, "b").otherwise("a").alias("mostly"),
        F.when(i == 4, 1).alias("gone"),
        (i + 9007199254740993).alias("key"),
    ).cache()


@pytest.fixture(scope="module")
def state(rows):
    parts = [FitState.of(rows.filter(F.col("id") % 3 == k), COLUMNS, ["x", "y", "one"]) for k in range(3)]
    return FitState.merged([parts[0], FitState.merged(parts[1:])])


def test_fits_of_batches_are_those_of_all_rows(rows, state):
    assert state.high_missing(0.9) == clean.fit_high_missing(rows.select(*COLUMNS), 0.9)
    assert state.constant() == sorted(clean.fit_constant(rows.select(*COLUMNS)))
    assert state.quasi_constant(0.99) == pytest.approx(clean.fit_quasi_constant(rows.select(*COLUMNS), 0.99))
    for method in ("iqr", "zscore"):
        want = clean.fit_outlier_bounds(rows, ["x", "y", "text"], method, 2.0)
        got = state.outlier_bounds(["x", "y", "text"], method, 2.0)
        assert set(got) == set(want)
        for c, bounds in want.items():
            assert got[c] == pytest.approx(bounds, rel=1e-9)
    assert state.outlier_bounds(["x"], "other") == {}
    assert state.whole(["x", "one"]) == ["x", "one"]
    r = {(x["a"], x["b"]): x["r"] for x in state.correlations().collect()}
    for pair, want in stats.correlation_values(rows, ["x", "y", "one"]).items():
        assert r[pair] == (pytest.approx(want, abs=1e-9) if want is not None else None)
    assert state.correlated(["x", "y", "one"], 0.9) == clean.fit_correlated(rows, ["x", "y", "one"], 0.9)


def test_distinct_long_keys_stay_apart(state):
    assert state.figures(["key"])["key"]["n_distinct"] == 500


def test_a_batch_that_is_stored_again_counts_once(spark, rows, state, tmp_path):
    for k in (0, 1, 2, 0):
        FitState.of(rows.filter(F.col("id") % 3 == k), COLUMNS, ["x", "y"]).write(str(tmp_path), k)
    read = FitState.read(spark, str(tmp_path))
    assert read.figures()["x"] == pytest.approx(state.figures()["x"])


def test_state_of_a_stream(spark, rows, tmp_path):
    plain = rows.select("x", "text")
    plain.repartition(4).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second start finds nothing new
        keep_state(arriving, str(tmp_path / "state"), str(tmp_path / "done")).awaitTermination()
    read = FitState.read(spark, str(tmp_path / "state"))
    assert read.figures(["x"])["x"] == pytest.approx(FitState.of(plain).figures(["x"])["x"])


def test_value_counts_of_odd_values(spark):
    df = spark.createDataFrame([(0.0, "a", [1]), (-0.0, None, [1]), (float("nan"), "A", None), (None, "a", [])], "x double, t string, l array<int>")
    counts = value_counts(df)
    held = {(r["column"], r["value"]): r["n"] for r in counts.collect()}
    assert held[("x", "0.0")] == 2 and held[("x", "NaN")] == 1 and held[("x", None)] == 1
    assert held[("t", "a")] == 2 and held[("l", "[1]")] == 2
    figures = {r["column"]: r for r in column_figures(counts, ["x", "t", "l", "absent"]).collect()}
    assert figures["t"]["n_distinct"] == 2 and figures["absent"]["n_rows"] == 0 and figures["t"]["top_share"] == pytest.approx(2 / 3)


def test_quantiles_of_counts(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 2, 10]] + [(None,)], "x double")
    found = quantiles(value_counts(df), [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]).first()["q"]
    assert found == pytest.approx([1, 1, 1, 2, 6.8, 10])


def test_statistics_read_their_rows_once(spark, rows):
    plan = pr.column_statistics(rows.select(*COLUMNS))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "x double, t string")
    assert {r["column"]: r["non_null"] for r in pr.column_statistics(empty).collect()} == {"x": 0, "t": 0}
    state = FitState.of(empty, paired=["x"])
    assert state.outlier_bounds(["x"]) == {} and state.correlations().count() == 0
