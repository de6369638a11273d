"""Missing-value rules on toy frames, expected values by hand."""

import pytest
from pyspark.sql import functions as F

from tablelab.functions import conditions as cond
from tablelab.functions import nulls
from tablelab.operators import clean
from tablelab.operators import features as fe


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(1, 2.0, 3.0), (2, None, 4.0), (3, None, None), (4, -1.0, 0.0)]
    return spark.createDataFrame(rows, "id int, a double, b double").cache()


def column(df, expr):
    return [r["x"] for r in df.select("id", expr.alias("x")).orderBy("id").collect()]


def feature(df, operation, columns, **parameters):
    out, fitted = fe.engineer(df, [{"name": "x", "operation": operation, "columns": columns, "parameters": parameters}])
    assert fitted.outcomes[0]["status"] == "created", fitted.outcomes
    return [r["x"] for r in out.orderBy("id").collect()]


def test_sum_and_product_ignore_nulls(toy):
    assert feature(toy, "add", ["a", "b"]) == [5.0, 4.0, 0.0, -1.0]
    assert feature(toy, "multiply", ["a", "b"]) == [6.0, 4.0, 1.0, 0.0]
    assert feature(toy, "subtract", ["a", "b"]) == [-1.0, None, None, -1.0]


def test_division(toy):
    assert feature(toy, "ratio", ["a", "b"]) == [pytest.approx(2 / 3), None, None, None]
    assert feature(toy, "divide", ["a", "b"])[3] == pytest.approx(-1e10)


def test_logs_and_powers_never_give_nan(toy):
    assert feature(toy, "log", ["a"])[3] is None
    assert feature(toy, "power", ["a"], exponent=0.5)[3] is None
    assert feature(toy, "sqrt", ["a"])[3] == 1.0


def test_clip_keeps_null(toy):
    assert feature(toy, "clip", ["a"], lower=0, upper=1) == [1.0, None, None, 0.0]
    assert feature(toy, "clip", ["a"]) == [2.0, None, None, -1.0]


def test_constant_columns_scale_to_zero_even_where_missing(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None)], "id int, a double")
    assert feature(df, "normalize", ["a"]) == [0.0, 0.0]
    assert feature(df, "standardize", ["a"]) == [0.0, 0.0]


def test_bins(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 5)] + [(9, None)], "id int, a double")
    assert fe.equal_width_edges(1.0, 4.0, 3)[0] == pytest.approx(0.997)
    assert feature(df, "bin", ["a"], n_bins=3, labels=["l", "m", "h"]) == ["l", "l", "m", "h", None]
    assert feature(df, "bin", ["a"], n_bins=2, method="equal_frequency", labels=["l", "h"]) == ["l", "l", "h", "h", None]
    assert fe.equal_frequency_edges([1.0, 1.0, 2.0, 4.0]) == [1.0, 2.0, 4.0]
    assert feature(df, "bin", ["a"], bins=[1, 2, 3]) == ["(1, 2]", "(1, 2]", "(2, 3]", None, None]
    assert len(fe.equal_width_edges(3.0, 3.0, 2)) == 3 and fe.equal_width_edges(3.0, 3.0, 2)[0] < 3.0


def test_first_listed_condition_wins(toy):
    cases = [{"condition": "b > 2", "value": 1}, {"condition": "b > 3", "value": 2}]
    assert feature(toy, "conditional", [], conditions=cases) == [1, 1, 0, 0]


def test_failed_definitions_are_recorded(toy):
    fitted = fe.fit_features(
        toy,
        [
            {"name": "p", "operation": "add", "columns": ["zz"]},
            {"name": "q", "operation": "ratio", "columns": ["a"]},
            {"name": "r", "operation": "formula", "parameters": {"formula": "a +"}},
            {"name": "s", "operation": "formula", "parameters": {"formula": "a + 1"}},
            {"name": "t", "operation": "abs", "columns": ["s"]},
        ],
    )
    assert [o["status"] for o in fitted.outcomes] == ["failed", "failed", "failed", "created", "created"]


NEGATIVE = {"!=": 2.0, "not_between": [2.0, 3.0], "not_in": [2.0]}
POSITIVE = {"==": 2.0, "<=": 2.0, ">=": 2.0, "between": [2.0, 3.0], "in": [2.0]}


@pytest.mark.parametrize("op", [*NEGATIVE, *POSITIVE, "<", ">"])
def test_conditions_on_null(toy, op):
    value = {**NEGATIVE, **POSITIVE}.get(op, 2.0)
    got = column(toy, cond.build({"column": "a", "operator": op, "value": value}, toy.columns)[0])
    assert None not in got
    assert got[1] is (op in NEGATIVE) and got[2] is (op in NEGATIVE)
    assert got[0] is (op in POSITIVE)


def test_condition_errors_and_skips(toy):
    bad = {"column": "zz", "operator": "<", "value": 1}
    odd = {"column": "a", "operator": "~", "value": 1}
    with pytest.raises(cond.ConditionError):
        cond.combine([bad], toy.columns)
    with pytest.raises(cond.ConditionError):
        cond.combine([], toy.columns, "xor")
    out = cond.combine([bad, odd], toy.columns, on_invalid="skip")
    assert len(out.warnings) == 2 and column(toy, out.column) == [False] * 4
    with pytest.raises(cond.ConditionError):
        cond.restrict_to_parent(F.lit(True), "zz", toy.columns)


def test_alias_resolution_order():
    aliases = {"LogP": ["xlogp", "logp"], "Area": ["tpsa"]}
    assert cond.resolve_column("LogP", ["LogP", "xlogp"], aliases) == "LogP"
    assert cond.resolve_column("LogP", ["logp", "xlogp"], aliases) == "xlogp"
    assert cond.resolve_column("TPSA", ["tpsa"], None) == "tpsa"
    assert cond.resolve_column("none", ["tpsa"], aliases) is None


def test_missing_texts_and_numbers(spark):
    rows = [(1, "NA"), (2, "  \t"), (3, "?"), (4, " 1.5 "), (5, "1d"), (6, "-2e3"), (7, None), (8, "12x")]
    df = spark.createDataFrame(rows, "id int, t string")
    assert column(clean.standardise_missing(df), F.col("t")) == [None, None, None, " 1.5 ", "1d", "-2e3", None, "12x"]
    assert column(df, nulls.to_number("t")) == [None, None, None, 1.5, None, -2000.0, None, None]
    assert column(spark.createDataFrame([(1, " a  ")], "id int, t string"), nulls.strip("t")) == ["a"]


def test_nan_does_not_survive(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "id int, a double")
    assert column(nulls.nan_to_null(df), F.col("a")) == [None, 1.0]


def test_integer_columns_with_fractions_stay(spark):
    df = spark.createDataFrame([(1, 1.0, "2"), (2, 1.5, None)], "id int, a double, t string")
    whole, fractional = clean.fit_integers(df, ["a", "t", "zz"])
    assert (whole, fractional) == (["t"], ["a"])
    assert dict(clean.enforce_types(df, whole).dtypes) == {"id": "int", "a": "double", "t": "bigint"}


def test_quasi_constant_candidate(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") < 995, F.lit("a")).otherwise(F.col("id").cast("string")).alias("most"),
        (F.col("id") % 2).alias("half"),
        F.lit(None).cast("string").alias("nothing"),
        F.when(F.col("id") % 3 == 0, F.lit(1.0)).alias("only"),
    )
    assert clean.fit_quasi_constant(df, 0.99) == {"most": pytest.approx(0.995), "only": 1.0}
    assert set(clean.fit_quasi_constant(df, 0.5)) == {"most", "only", "half"}


def test_correlated_columns_use_the_full_matrix():
    r = {("a", "b"): 0.99, ("b", "c"): -0.99, ("a", "c"): 0.1, ("a", "d"): None}
    assert clean.correlated_columns(["a", "b", "c", "d"], r, 0.95) == ["b", "c"]


def test_whole_numbers_beyond_double_keep_their_digits(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, str(big), 1), (-big, " -3 ", -1), (0, "2.0", 0), (None, "x", None)], "n long, t string, i int")
    whole, rest = clean.fit_integers(df, ["n", "t", "i"])
    assert (whole, rest) == (["n", "t", "i"], [])
    assert [tuple(r) for r in clean.enforce_types(df, whole).collect()] == [(big, big, 1), (-big, -3, -1), (0, 2, 0), (None, None, None)]
    out = clean.null_zeros(clean.null_negatives(df, ["n", "i"]), ["n", "i"])
    assert dict(out.dtypes)["n"] == "bigint" and [tuple(r)[::2] for r in out.collect()] == [(big, 1), (None, None), (None, None), (None, None)]
    assert clean.coerce_numeric(df, ["n"]).first()["n"] == big
