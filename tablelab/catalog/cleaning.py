"""Queries of the cleaning operators over the dirty part view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conditions as cond
from ..operators import clean as c
from ..plans.clean import clean
from .base import query, sql, table, view

V = "dirty_part"
TEXTS = ("brand", "size_txt", "name", "kind", "quasi", "sparse")
COLUMNS = ("id", "price", "size", "brand", "size_txt", "name", "kind", "const", "quasi", "sparse", "price2")
MISSING_SQL = "'', 'NA', 'N/A', 'NaN', 'nan', 'null', 'None', '.', '-', '?'"


def _std(col: str) -> str:
    return f"CASE WHEN {col} IN ({MISSING_SQL}) OR regexp_full_match({col}, '\\s*') THEN NULL ELSE {col} END"


def _n_missing(cols=COLUMNS) -> str:
    return "(" + " + ".join(f"CAST({x} IS NULL AS INTEGER)" for x in cols) + ")"


NUMBER_SQL = "CASE WHEN regexp_full_match(size_txt, '[+-]?\\d+(\\.\\d+)?') THEN CAST(size_txt AS DOUBLE) END"


@query("m1_missing_indicators", sql(f"SELECT id, {_std('brand')} AS brand, {_std('size_txt')} AS size_txt, {_std('sparse')} AS sparse FROM {V}", V))
def _(s, d):
    return c.standardise_missing(view(s, d, V)).select("id", "brand", "size_txt", "sparse")


@query("m2_row_missing", sql(f"SELECT id, price, size FROM {V} WHERE {_n_missing()} / 11.0 <= 0.15", V, doubles="price size"))
def _(s, d):
    df = view(s, d, V)
    return df.filter(c.enough_values(df.columns, 0.15)).select("id", "price", "size")


@query(
    "m2_dropped_stats",
    sql(
        f"""SELECT count(*) AS n_rows, count(m) AS dropped, min(m) AS min_missing_pct, max(m) AS max_missing_pct,
        avg(m) AS avg_missing_pct FROM (SELECT CASE WHEN {_n_missing()} / 11.0 > 0.15
        THEN CAST({_n_missing()} * 100 AS DOUBLE) / 11 END AS m FROM {V})""",
        V,
        doubles="min_missing_pct max_missing_pct avg_missing_pct",
    ),
)
def _(s, d):
    return c.dropped_row_stats(view(s, d, V), 0.15)


@query("m3_required", sql(f"SELECT id, price, size FROM {V} WHERE price IS NOT NULL AND size IS NOT NULL", V, doubles="price size"))
def _(s, d):
    df = view(s, d, V)
    return df.filter(c.has_all(["price", "size"])).select("id", "price", "size")


def _breakdown(col: str) -> str:
    return f"""SELECT '{col}' AS "column", true AS present, count(*) - count({col}) AS missing,
    round((count(*) - count({col})) * 100.0 / count(*), 2)::DOUBLE AS missing_pct, count({col}) AS with_value FROM {V}"""


@query(
    "m3_breakdown",
    sql(
        " UNION ALL ".join(map(_breakdown, ("price", "size")))
        + " UNION ALL SELECT 'absent', false, NULL, NULL, NULL",
        V,
        doubles="missing_pct",
    ),
)
def _(s, d):
    return c.missing_breakdown(view(s, d, V), ["price", "size", "absent"])


@query("m4_drop_numeric", sql(f"SELECT id, size, const FROM {V} WHERE size IS NOT NULL AND const IS NOT NULL", V, doubles="size const"))
def _(s, d):
    df = view(s, d, V)
    numbers = c.numeric_without_required(df, ["size", "nope"], ["const", "price", "size"], ["price"])
    return df.filter(c.has_all(numbers)).select("id", "size", "const")


def _dedup(order: str) -> str:
    return sql(
        f"""SELECT id, kind, size FROM (SELECT *, row_number() OVER (PARTITION BY kind, size ORDER BY id {order}) AS rn
        FROM {V}) WHERE rn = 1""",
        V,
        doubles="size",
    )


@query("m5_dedup_first", _dedup("ASC"))
def _(s, d):
    return c.deduplicate(view(s, d, V), ["kind", "size"], ["id"], "first").select("id", "kind", "size")


@query("m5_dedup_last", _dedup("DESC"))
def _(s, d):
    return c.deduplicate(view(s, d, V), ["kind", "size"], ["id"], "last").select("id", "kind", "size")


@query(
    "m5_dedup_none",
    sql(f"SELECT min(id) AS id, brand, size FROM {V} GROUP BY brand, size HAVING count(*) = 1", V, doubles="size"),
)
def _(s, d):
    return c.deduplicate(view(s, d, V), ["brand", "size"], ["id"], False).select("id", "brand", "size")


@query("m6_strip", sql(f"SELECT id, regexp_replace(brand, '^\\s+|\\s+$', '', 'g') AS brand FROM {V}", V))
def _(s, d):
    return c.strip_text(view(s, d, V)).select("id", "brand")


@query("m7_lower", sql(f"SELECT id, lower(brand) AS brand, lower(name) AS name FROM {V}", V))
def _(s, d):
    return c.lower_text(view(s, d, V), ["brand", "name", "absent"]).select("id", "brand", "name")


@query("m8_coerce", sql(f"SELECT id, {NUMBER_SQL} AS size_txt FROM {V}", V, doubles="size_txt"))
def _(s, d):
    return c.coerce_numeric(view(s, d, V), ["size_txt"]).select("id", "size_txt")


@query(
    "m9_negatives",
    sql(f"SELECT id, CASE WHEN NOT size < 0 THEN size END AS size, CASE WHEN NOT x < 0 THEN x END AS size_txt FROM (SELECT *, {NUMBER_SQL} AS x FROM {V})", V, doubles="size size_txt"),
)
def _(s, d):
    return c.null_negatives(view(s, d, V), ["size", "size_txt"]).select("id", "size", "size_txt")


@query(
    "m9_negative_counts",
    sql(
        f"""SELECT 'size' AS "column", count_if(size < 0)::BIGINT AS n FROM {V} UNION ALL
        SELECT 'size_txt', count_if({NUMBER_SQL} < 0)::BIGINT FROM {V}""",
        V,
    ),
)
def _(s, d):
    return c.count_where(view(s, d, V), ["size", "size_txt"], lambda v: v < 0)


@query("m10_zeros", sql(f"SELECT id, nullif({NUMBER_SQL}, 0) AS size_txt FROM {V}", V, doubles="size_txt"))
def _(s, d):
    return c.null_zeros(view(s, d, V), ["size_txt"]).select("id", "size_txt")


@query(
    "m11_iqr",
    sql(
        f"""SELECT id, CASE WHEN price < p1 - 0.3 * (p3 - p1) OR price > p3 + 0.3 * (p3 - p1) THEN NULL ELSE price END AS price,
        CASE WHEN size < s1 - 0.3 * (s3 - s1) OR size > s3 + 0.3 * (s3 - s1) THEN NULL ELSE size END AS size
        FROM {V}, (SELECT quantile_cont(price, 0.25) p1, quantile_cont(price, 0.75) p3,
        quantile_cont(size, 0.25) s1, quantile_cont(size, 0.75) s3 FROM {V})""",
        V,
        doubles="price size",
    ),
)
def _(s, d):
    df = view(s, d, V)
    return c.null_outliers(df, c.fit_outlier_bounds(df, ["price", "size"], "iqr", 0.3)).select("id", "price", "size")


@query(
    "m12_zscore",
    sql(
        f"""SELECT id, CASE WHEN price < m - 1.5 * v OR price > m + 1.5 * v THEN NULL ELSE price END AS price
        FROM {V}, (SELECT avg(price) m, stddev_samp(price) v FROM {V})""",
        V,
        doubles="price",
    ),
)
def _(s, d):
    df = view(s, d, V)
    return c.null_outliers(df, c.fit_outlier_bounds(df, ["price"], "zscore", 1.5)).select("id", "price")


# Keys beyond 2**53 keep their digits; every 50th line has one far away.
_LONG_KEYS = "SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey % 50 = 0 THEN 8000000000000000001 ELSE 9007199254740993 + l_orderkey END AS big FROM {lineitem}"


def _long_keys(s, d):
    return s.sql(_LONG_KEYS, lineitem=table(s, d, "lineitem"))


@query(
    "m11_long_keys",
    sql(
        f"""SELECT id, CASE WHEN big < q1 - 3 * (q3 - q1) OR big > q3 + 3 * (q3 - q1) THEN NULL ELSE big END AS big
        FROM ({_LONG_KEYS.format(lineitem='lineitem')}), (SELECT quantile_cont(big::DOUBLE, 0.25) q1, quantile_cont(big::DOUBLE, 0.75) q3 FROM ({_LONG_KEYS.format(lineitem='lineitem')}))"""
    ),
)
def _(s, d):
    df = _long_keys(s, d)
    return c.null_outliers(df, c.fit_outlier_bounds(df, ["big"], "iqr", 3.0))


@query(
    "m12_long_keys",
    sql(
        f"""SELECT id, CASE WHEN big < m - 3 * v OR big > m + 3 * v THEN NULL ELSE big END AS big
        FROM ({_LONG_KEYS.format(lineitem='lineitem')}), (SELECT avg(big::DOUBLE) m, stddev_samp(big::DOUBLE) v FROM ({_LONG_KEYS.format(lineitem='lineitem')}))"""
    ),
)
def _(s, d):
    df = _long_keys(s, d)
    return c.null_outliers(df, c.fit_outlier_bounds(df, ["big"], "zscore", 3.0))


@query("m13_integer", sql(f"SELECT id, CAST(size AS BIGINT) AS size, price2, size_txt FROM {V}", V, doubles="price2"))
def _(s, d):
    df = view(s, d, V)
    whole, _ = c.fit_integers(df, ["size", "price2", "size_txt"])
    return c.enforce_types(df, whole).select("id", "size", "price2", "size_txt")


@query("m14_float", sql(f"SELECT CAST(id AS DOUBLE) AS id, {NUMBER_SQL} AS size_txt FROM {V}", V, doubles="id size_txt"))
def _(s, d):
    return c.enforce_types(view(s, d, V), floats=["id", "size_txt"]).select("id", "size_txt")


@query("m15_string", sql(f"SELECT CAST(id AS VARCHAR) AS id, nullif(quasi, 'nan') AS quasi, CAST(size AS VARCHAR) AS size FROM {V}", V))
def _(s, d):
    return c.enforce_types(view(s, d, V), strings=["id", "quasi", "size"]).select("id", "quasi", "size")


@query("m16_validate", sql(f"SELECT id, size_txt FROM {V} WHERE regexp_full_match(size_txt, '[0-9]+')", V))
def _(s, d):
    rows, _ = c.validate(view(s, d, V), "size_txt", F.col("size_txt").rlike("^[0-9]+$"), drop=True)
    return rows.select("id", "size_txt")


@query(
    "m16_validity_report",
    sql(f"SELECT count_if(coalesce(sparse = 'x', false))::BIGINT AS valid, count_if(NOT coalesce(sparse = 'x', false))::BIGINT AS invalid FROM {V}", V),
)
def _(s, d):
    return c.validate(view(s, d, V), "sparse", F.col("sparse") == "x")[1]


@query("m17_separator", sql(f"SELECT id, name FROM {V} WHERE NOT coalesce(contains(name, '.'), false)", V))
def _(s, d):
    return view(s, d, V).filter(c.without_text("name")).select("id", "name")


@query("m18_coalesce", sql("SELECT id, coalesce(measured, typical) AS value FROM rule_truth", "rule_truth", doubles="value"))
def _(s, d):
    return view(s, d, "rule_truth").select("id", c.first_value("measured", "typical").alias("value"))


@query("p1_drop_columns", sql(f"SELECT * EXCLUDE (const, quasi, sparse) FROM {V}", V, doubles="price size price2"))
def _(s, d):
    return c.drop_columns(view(s, d, V), ["const", "quasi", "sparse", "absent"])


@query("p2_keep_columns", sql(f"SELECT id, price, kind FROM {V}", V, doubles="price"))
def _(s, d):
    return c.keep_columns(view(s, d, V), ["id", "price", "absent", "kind", "price"])


def _per_column(expr: str, cols=COLUMNS) -> str:
    return " UNION ALL ".join(f"SELECT '{x}' AS \"column\", {expr.format(c=x)} AS value FROM {V}" for x in cols)


@query(
    "p3_high_missing",
    sql(f"SELECT \"column\", value AS missing_share FROM ({_per_column('avg(CAST({c} IS NULL AS INTEGER))')}) WHERE value > 0.9", V, doubles="missing_share"),
)
def _(s, d):
    found = c.fit_high_missing(view(s, d, V), 0.9)
    return s.createDataFrame(list(found.items()), "column string, missing_share double")


@query("p4_constant", sql(f"SELECT \"column\" FROM ({_per_column('count(DISTINCT {c})')}) WHERE value <= 1", V))
def _(s, d):
    return s.createDataFrame([(x,) for x in c.fit_constant(view(s, d, V))], "column string")


_TOP = " UNION ALL ".join(
    f"""SELECT '{x}' AS "column", CAST(max(n) AS DOUBLE) / sum(n) AS top_share
    FROM (SELECT count(*) AS n FROM {V} WHERE {x} IS NOT NULL GROUP BY {x})"""
    for x in COLUMNS
)


@query("p5_quasi_constant", sql(f"SELECT * FROM ({_TOP}) WHERE top_share >= 0.99", V, doubles="top_share"))
def _(s, d):
    found = c.fit_quasi_constant(view(s, d, V), 0.99)
    return s.createDataFrame(list(found.items()), "column string, top_share double")


@query("p5_value_shares", sql(_TOP, V, doubles="top_share"))
def _(s, d):
    return c.value_shares(view(s, d, V))


@query(
    "p6_correlated",
    sql(
        f"""SELECT 'size' AS "column" FROM {V} HAVING abs(corr(price, size)) > 0.95 UNION ALL
        SELECT 'price2' FROM {V} HAVING abs(corr(price, price2)) > 0.95 OR abs(corr(size, price2)) > 0.95""",
        V,
    ),
)
def _(s, d):
    found = c.fit_correlated(view(s, d, V), ["price", "size", "price2", "const"], 0.95)
    return s.createDataFrame([(x,) for x in found], "column string")


@query(
    "f1_range",
    sql(f"SELECT id, price, size FROM {V} WHERE (price BETWEEN 950 AND 1500 OR price IS NULL) AND (size BETWEEN 0 AND 30 OR size IS NULL)", V, doubles="price size"),
)
def _(s, d):
    df = view(s, d, V)
    steps = [("price", c.in_range(F.col("price"), 950.0, 1500.0)), ("size", c.in_range(F.col("size"), 0.0, 30.0))]
    kept, _, _ = c.run_row_steps(df, steps)
    return kept.select("id", "price", "size")


CLEAN_CONFIG = {
    "column_handling": {"drop_columns": ["price2"], "keep_columns": None, "required_columns": ["price"]},
    "missing_value_handling": {
        "strategy": "drop_rows",
        "missing_threshold_columns": 0.9,
        "missing_threshold_rows": 0.25,
        "drop_rows_with_missing_required": True,
    },
    "duplicate_handling": {"remove_duplicates": True, "duplicate_subset": ["kind", "size"], "keep_strategy": "first"},
    "text_cleaning": {"enabled": True, "lowercase_columns": ["name"]},
    "numeric_cleaning": {"enabled": True, "remove_negative_values_columns": ["size"]},
    "row_validation": {"separator_column": "name"},
    "data_type_enforcement": {"enabled": True, "integer_columns": ["size"], "float_columns": ["price"]},
    "feature_selection": {"enabled": True, "remove_constant_columns": True},
    "filtering": {"enabled": True, "ranges": {"price": [900, 1600]}},
}

# The chain of survivors in SQL: s = standardised, a = after each step.
_A1 = f"""
s AS (SELECT id, price, size, {_std('brand')} AS brand, {_std('size_txt')} AS size_txt, name, kind, const, quasi FROM {V}),
a1 AS (SELECT * FROM s WHERE {_n_missing(("id", "price", "size", "brand", "size_txt", "name", "kind", "const", "quasi"))} / 9.0 <= 0.25),
a2 AS (SELECT * FROM a1 WHERE price IS NOT NULL),
a3 AS (SELECT * FROM a2 WHERE size IS NOT NULL),
a4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, size ORDER BY id) AS rn FROM a3) WHERE rn = 1),
a5 AS (SELECT * FROM a4 WHERE NOT contains(name, '.')),
a6 AS (SELECT * FROM a5 WHERE price BETWEEN 900 AND 1600)"""


@query(
    "a1_steps",
    sql(
        " UNION ALL ".join(
            f"SELECT '{step}' AS step, (SELECT count(*) FROM {b}) AS rows_before, (SELECT count(*) FROM {a}) AS rows_after"
            for step, b, a in (
                ("high_missing_rows", "s", "a1"),
                ("missing_required", "a1", "a2"),
                ("missing_numeric", "a2", "a3"),
                ("duplicates", "a3", "a4"),
                ("separator", "a4", "a5"),
                ("range_price", "a5", "a6"),
            )
        ),
        V,
        ctes=_A1,
    ),
)
def _(s, d):
    report = clean(view(s, d, V), CLEAN_CONFIG, ["id"]).report()
    row_steps = ["high_missing_rows", "missing_required", "missing_numeric", "duplicates", "separator", "range_price"]
    return report.filter(F.col("step").isin(row_steps)).select("step", "rows_before", "rows_after")


@query(
    "clean_run",
    sql(
        "SELECT id, price, CASE WHEN NOT size < 0 THEN CAST(size AS BIGINT) END AS size, trim(brand) AS brand, lower(name) AS name, kind FROM a6",
        V,
        doubles="price",
        ctes=_A1,
    ),
)
def _(s, d):
    return clean(view(s, d, V), CLEAN_CONFIG, ["id"]).df.select("id", "price", "size", "brand", "name", "kind")


@query("f11_complete_cases", sql(f"SELECT id, price, size FROM {V} WHERE price IS NOT NULL AND sparse IS NOT NULL", V, doubles="price size"))
def _(s, d):
    return cond.complete_cases(view(s, d, V), ["price", "sparse"]).select("id", "price", "size")


@query("f12_measured_only", sql("SELECT id, measured FROM rule_truth WHERE measured IS NOT NULL AND origin = 'measured'", "rule_truth", doubles="measured"))
def _(s, d):
    return view(s, d, "rule_truth").filter(cond.measured_only("measured", "origin")).select("id", "measured")
