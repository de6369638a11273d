"""Queries of derived columns, labels, conditions and subsets, and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conditions as cond
from ..operators import labeling as lab
from ..operators import subsets as sub
from ..operators.features import engineer, fit_features
from ..plans.label import derive_label_flag
from .base import query, sql, table, view

V = "dirty_part"
D = "label_docs"

# --- derived columns: (query, definition, SQL expression, result is a double) ----------------------


def _feature(name: str, operation: str, columns: list[str], **params) -> dict:
    return {"name": "x", "operation": operation, "columns": columns, "parameters": params}


_N = f"(SELECT min(size) lo, max(size) hi, avg(size) m, stddev_samp(size) s FROM {V})"
_W = "(hi - lo) / 4"
DERIVED = [
    ("d1_add", _feature("x", "add", ["price", "size"]), "coalesce(price, 0) + coalesce(size, 0)", ""),
    ("d2_subtract", _feature("x", "subtract", ["price", "size"]), "price - size", ""),
    ("d3_multiply", _feature("x", "multiply", ["price", "size"]), "coalesce(price, 1) * coalesce(size, 1)", ""),
    ("d4_divide", _feature("x", "divide", ["price", "size"]), "price / (size + 1e-10)", ""),
    ("d5_ratio", _feature("x", "ratio", ["price", "size_txt"]), "price / nullif(t, 0)", ""),
    ("d6_log", _feature("x", "log", ["size"]), "CASE WHEN size + 1 > 0 THEN ln(size + 1) END", ""),
    ("d7_log10", _feature("x", "log10", ["price"], offset=2), "log10(price + 2)", ""),
    ("d8_sqrt", _feature("x", "sqrt", ["size"]), "sqrt(abs(size))", ""),
    ("d9_power", _feature("x", "power", ["size"], exponent=1.5), "CASE WHEN size >= 0 THEN pow(size, 1.5) END", ""),
    ("d10_abs", _feature("x", "abs", ["size"]), "abs(size)", ""),
    ("d11_clip", _feature("x", "clip", ["size"], lower=5, upper=30), "CASE WHEN size < 5 THEN 5 WHEN size > 30 THEN 30 ELSE size END", ""),
    ("d12_normalize", _feature("x", "normalize", ["size"]), "(size - lo) / (hi - lo)", _N),
    ("d12_normalize_constant", _feature("x", "normalize", ["const"]), "CAST(0 AS DOUBLE)", ""),
    ("d13_standardize", _feature("x", "standardize", ["size"]), "(size - m) / s", _N),
    ("d17_formula", _feature("x", "formula", [], formula="price2 - 2 * size"), "price2 - 2 * size", ""),
    ("d19_interaction", _feature("x", "interaction", ["size", "const"]), "coalesce(size, 1) * const", ""),
    ("d20_polynomial", _feature("x", "polynomial", ["size"], degree=3), "pow(size, 3)", ""),
]
BINNED = [
    (
        "d14_bin_edges",
        _feature("x", "bin", ["size"], bins=[0, 10, 20, 40], labels=["low", "mid", "high"]),
        "CASE WHEN size < 0 THEN NULL WHEN size <= 10 THEN 'low' WHEN size <= 20 THEN 'mid' WHEN size <= 40 THEN 'high' END",
        "",
    ),
    (
        "d15_bin_width",
        _feature("x", "bin", ["size"], n_bins=4, method="equal_width", labels=["a", "b", "c", "d"]),
        f"CASE WHEN size <= lo + {_W} THEN 'a' WHEN size <= lo + 2 * ({_W}) THEN 'b' WHEN size <= lo + 3 * ({_W}) THEN 'c' WHEN size <= hi THEN 'd' END",
        _N,
    ),
    (
        "d16_bin_frequency",
        _feature("x", "bin", ["size"], n_bins=4, method="equal_frequency", labels=["a", "b", "c", "d"]),
        "CASE WHEN size <= q[2] THEN 'a' WHEN size <= q[3] THEN 'b' WHEN size <= q[4] THEN 'c' WHEN size <= q[5] THEN 'd' END",
        f"(SELECT quantile_cont(size, [0, 0.25, 0.5, 0.75, 1]) AS q FROM {V})",
    ),
    (
        "d18_conditional",
        _feature(
            "x", "conditional", [], default="none",
            conditions=[{"condition": "size > 30", "value": "large"}, {"condition": "size > 10", "value": "medium"}],
        ),
        "CASE WHEN size > 30 THEN 'large' WHEN size > 10 THEN 'medium' ELSE 'none' END",
        "",
    ),
]


def _derived_query(definition: dict):
    def run(s, d):
        df, _ = engineer(view(s, d, V), [definition])
        return df.select("id", "x")

    return run


for _name, _definition, _expr, _from in DERIVED + BINNED:
    _text = "CASE WHEN regexp_full_match(size_txt, '[+-]?\\d+(\\.\\d+)?') THEN CAST(size_txt AS DOUBLE) END AS t"
    _source = f"(SELECT *, {_text} FROM {V})" + (f", {_from}" if _from else "")
    _is_text = any(_name == b[0] for b in BINNED)
    query(_name, sql(f"SELECT id, {_expr} AS x FROM {_source}", V, doubles="" if _is_text else "x"))(_derived_query(_definition))


@query(
    "d21_report",
    sql(
        f"""SELECT 'total' AS name, 'created' AS status, count(*) AS non_null FROM {V}
        UNION ALL SELECT 'per_size', 'created', count(CASE WHEN size <> 0 THEN price / size END) FROM {V}
        UNION ALL SELECT 'double_total', 'created', count(*) FROM {V}
        UNION ALL SELECT 'bad_input', 'failed', NULL
        UNION ALL SELECT 'bad_operation', 'failed', NULL
        UNION ALL SELECT 'bad_formula', 'failed', NULL""",
        V,
    ),
)
def _(s, d):
    df = view(s, d, V)
    fitted = fit_features(
        df,
        [
            {"name": "total", "operation": "add", "columns": ["price", "size"]},
            {"name": "per_size", "operation": "ratio", "columns": ["price", "size"]},
            {"name": "double_total", "operation": "add", "columns": ["total", "total"]},
            {"name": "bad_input", "operation": "add", "columns": ["price", "absent"]},
            {"name": "bad_operation", "operation": "cube_root", "columns": ["price"]},
            {"name": "bad_formula", "operation": "formula", "parameters": {"formula": "price +* 2"}},
        ],
    )
    return fitted.report(df).select("name", "status", "non_null")


# --- labels --------------------------------------------------------------------------------------

LABELS = [lab.Label("tech", ("data", "license")), lab.Label("fill", ("the", "and")), lab.Label("none", ("soil", "water")),
          lab.Label("off", ("data",), enabled=False), lab.Label("blank")]
NAMES = ["tech", "fill", "none", "blank"]
TEXT = ["body", "source", "note", "absent"]
TEXT_SQL = "lower(concat(coalesce(body, ''), ' ', coalesce(source, ''), ' ', coalesce(note, '')))"


def _has(*words: str) -> str:
    return "CAST(" + " OR ".join(f"contains(t, '{w}')" for w in words) + " AS INTEGER)"


LABEL_CTE = f"""labelled AS (SELECT *, {_has('data', 'license')} AS tech, {_has('the', 'and')} AS fill,
{_has('soil', 'water')} AS none, 0 AS blank FROM (SELECT *, {TEXT_SQL} AS t FROM {D}))"""


def labelled(s, d, options=lab.MatchOptions()):
    return lab.label_rows(view(s, d, D), LABELS, TEXT, options)[0]


@query("l1_substring", sql("SELECT id, tech, fill, none, blank FROM labelled", D, ctes=LABEL_CTE))
def _(s, d):
    return labelled(s, d).select("id", *NAMES)


def _word(words: str) -> str:
    return f"CAST(regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])({words})($|[^\\p{{L}}\\p{{N}}_])') AS INTEGER)"


@query(
    "l2_whole_word",
    sql(f"SELECT id, {_word('data|license')} AS tech, {_word('the|and')} AS fill, {_word('soil|water')} AS none FROM (SELECT *, {TEXT_SQL} AS t FROM {D})", D),
)
def _(s, d):
    return labelled(s, d, lab.MatchOptions(match_whole_word=True)).select("id", "tech", "fill", "none")


@query(
    "l3_regex",
    sql(
        f"""SELECT id, CAST(regexp_matches(t, 'lic[ae]n|d[aeiou]t\\S') AS INTEGER) AS pattern, 0 AS broken
        FROM (SELECT *, {TEXT_SQL} AS t FROM {D})""",
        D,
    ),
)
def _(s, d):
    rules = [lab.Label("pattern", ("lic[ae]n", r"D[aeiou]t\S", "(open")), lab.Label("broken", ("[z",))]
    df, plan = lab.label_rows(view(s, d, D), rules, TEXT, lab.MatchOptions(use_regex=True))
    assert len(plan.warnings) == 2, plan.warnings
    return df.select("id", "pattern", "broken")


@query(
    "l4_case_sensitive",
    sql(f"SELECT id, CAST(contains(t, 'The') AS INTEGER) AS capital FROM (SELECT *, concat(coalesce(body, ''), ' ', coalesce(source, ''), ' ', coalesce(note, '')) AS t FROM {D})", D),
)
def _(s, d):
    df, _ = lab.label_rows(view(s, d, D), [lab.Label("capital", ("The",))], TEXT, lab.MatchOptions(case_sensitive=True))
    return df.select("id", "capital")


@query(
    "l6_min_matches",
    sql(f"SELECT id, CAST(contains(t, 'data') AND contains(t, 'license') AS INTEGER) AS tech FROM (SELECT *, {TEXT_SQL} AS t FROM {D})", D),
)
def _(s, d):
    return labelled(s, d, lab.MatchOptions(minimum_keyword_matches=2)).select("id", "tech")


#: 400 keywords, by rule: a consonant-vowel pair with a letter behind it.
MANY = [a + b + c for a in "bcdlmnprst" for b in "aeiou" for c in "aelnorst"]
_MANY_SQL = "(SELECT unnest([" + ", ".join(f"'{w}'" for w in MANY) + "]) AS keyword)"
_TEXTS = f"(SELECT id, {TEXT_SQL} AS t FROM {D})"


@query("l7_many_keywords", sql(f"SELECT keyword, sum((length(t) - length(replace(t, keyword, ''))) // 3)::BIGINT AS occurrences FROM {_TEXTS}, {_MANY_SQL} GROUP BY keyword", D))
def _(s, d):
    df = view(s, d, D)
    return lab.keyword_counts(df, lab.combined_text(df, TEXT), MANY)


@query("l8_many_keywords", sql(f"SELECT substr(keyword, 1, 1) AS label, keyword, count_if(contains(t, keyword)) AS rows FROM {_TEXTS}, {_MANY_SQL} GROUP BY keyword", D))
def _(s, d):
    df = view(s, d, D)
    labels = [lab.Label(a, tuple(w for w in MANY if w[0] == a)) for a in "bcdlmnprst"]
    return lab.keyword_statistics(df, lab.combined_text(df, TEXT), labels)


@query(
    "l6_many_keywords",
    sql(
        "SELECT id, " + ", ".join(f"CAST(count_if(substr(keyword, 1, 1) = '{a}' AND contains(t, keyword)) >= 20 AS INTEGER) AS with_{a}" for a in "bcdlmnprst")
        + f" FROM {_TEXTS}, {_MANY_SQL} GROUP BY id",
        D,
    ),
)
def _(s, d):
    labels = [lab.Label(f"with_{a}", tuple(w for w in MANY if w[0] == a)) for a in "bcdlmnprst"]
    out, _ = lab.label_rows(view(s, d, D), labels, TEXT, lab.MatchOptions(minimum_keyword_matches=20))
    return out.select("id", *[lb.name for lb in labels])


def _n_hits(w: str) -> str:
    return f"SELECT '{w}' AS keyword, sum((length(t) - length(replace(t, '{w}', ''))) // {len(w)})::BIGINT AS occurrences FROM labelled"


@query("l7_counts", sql(" UNION ALL ".join(map(_n_hits, ("data", "the", "soil"))), D, ctes=LABEL_CTE))
def _(s, d):
    df = view(s, d, D)
    return lab.keyword_counts(df, lab.combined_text(df, TEXT), ["data", "the", "soil"])


@query(
    "l8_keyword_stats",
    sql(
        " UNION ALL ".join(
            f"SELECT '{n}' AS label, '{w}' AS keyword, count_if(contains(t, '{w}'))::BIGINT AS rows FROM labelled"
            for n, w in (("tech", "data"), ("tech", "license"), ("fill", "the"), ("fill", "and"), ("none", "soil"), ("none", "water"))
        ),
        D,
        ctes=LABEL_CTE,
    ),
)
def _(s, d):
    df = view(s, d, D)
    return lab.keyword_statistics(df, lab.combined_text(df, TEXT), LABELS)


@query(
    "l9_counts",
    sql(
        " UNION ALL ".join(
            f"SELECT '{n}' AS label, sum({n})::BIGINT AS n, round(100 * avg({n}), 2) AS percent FROM labelled" for n in NAMES
        ),
        D,
        ctes=LABEL_CTE,
        doubles="percent",
    ),
)
def _(s, d):
    return lab.label_counts(labelled(s, d), NAMES)


@query(
    "l10_overlap",
    sql(
        " UNION ALL ".join(
            f"SELECT '{a}' AS label_a, '{b}' AS label_b, sum({a} * {b})::BIGINT AS n FROM labelled"
            for a in ("tech", "fill", "none")
            for b in ("tech", "fill", "none")
        ),
        D,
        ctes=LABEL_CTE,
    ),
)
def _(s, d):
    return lab.label_overlap(labelled(s, d), ["tech", "fill", "none"])


@query(
    "l11_unlabelled",
    sql(
        "SELECT count(*) AS n_rows, count_if(tech + fill + none = 0)::BIGINT AS unlabelled, count_if(tech + fill + none > 1)::BIGINT AS multi_label FROM labelled",
        D,
        ctes=LABEL_CTE,
    ),
)
def _(s, d):
    return lab.label_coverage(labelled(s, d), ["tech", "fill", "none"])


@query(
    "p9_combination",
    sql(
        """SELECT id, coalesce(nullif(concat_ws(' + ', CASE WHEN tech = 1 THEN 'Tech' END, CASE WHEN fill = 1 THEN 'Fill' END,
        CASE WHEN none = 1 THEN 'None' END), ''), 'Unlabeled') AS domain FROM labelled""",
        D,
        ctes=LABEL_CTE,
    ),
)
def _(s, d):
    return labelled(s, d).select("id", lab.combination(["tech", "fill", "none"]).alias("domain"))


@query(
    "p10_unpivot",
    sql(f"SELECT id, 'price' AS feature, price AS value FROM {V} UNION ALL SELECT id, 'size', size FROM {V}", V, doubles="value"),
)
def _(s, d):
    return lab.unpivot(view(s, d, V), ["id"], ["price", "size"])


@query("p11_text", sql(f"SELECT id, {TEXT_SQL} AS text FROM {D}", D))
def _(s, d):
    df = view(s, d, D)
    return df.select("id", lab.combined_text(df, TEXT).alias("text"))


# --- conditions ----------------------------------------------------------------------------------

CONDITIONS = {
    "f2_compare": {
        "le": ("size", "<=", 20, "coalesce(size <= 20, false)"),
        "lt": ("size", "<", 20, "coalesce(size < 20, false)"),
        "ge": ("size", ">=", 20, "coalesce(size >= 20, false)"),
        "gt": ("size", ">", 20, "coalesce(size > 20, false)"),
        "eq": ("size", "==", 20, "coalesce(size = 20, false)"),
    },
    "f3_not_equal": {"ne": ("size", "!=", 20, "size IS DISTINCT FROM 20")},
    "f4_between": {"hit": ("size", "between", [5, 25], "coalesce(size BETWEEN 5 AND 25, false)")},
    "f5_not_between": {"hit": ("size", "not_between", [5, 25], "NOT coalesce(size BETWEEN 5 AND 25, false)")},
    "f6_in": {"hit": ("size", "in", [3, 7, 20], "coalesce(size IN (3, 7, 20), false)")},
    "f7_not_in": {"hit": ("size", "not_in", [3, 7, 20], "NOT coalesce(size IN (3, 7, 20), false)")},
}


def _condition_query(tests: dict):
    def run(s, d):
        df = view(s, d, V)
        cols = [cond.build({"column": c, "operator": o, "value": v}, df.columns)[0].cast("int").alias(k) for k, (c, o, v, _) in tests.items()]
        return df.select("id", *cols)

    return run


for _name, _tests in CONDITIONS.items():
    _cols = ", ".join(f"CAST({t[3]} AS INTEGER) AS {k}" for k, t in _tests.items())
    query(_name, sql(f"SELECT id, {_cols} FROM {V}", V))(_condition_query(_tests))

ALIASES = {"Cost": ["retail", "price"], "Extent": ["size"]}
PAIR = [{"column": "Cost", "operator": ">", "value": 950}, {"column": "SIZE", "operator": "!=", "value": 10}]


@query(
    "f8_description",
    sql(
        f"""SELECT 'price > 950' AS description, count_if(coalesce(price > 950, false))::BIGINT AS n FROM {V}
        UNION ALL SELECT 'size != 10', count_if(size IS DISTINCT FROM 10)::BIGINT FROM {V}""",
        V,
    ),
)
def _(s, d):
    df = view(s, d, V)
    built = [cond.build(x, df.columns, ALIASES) for x in PAIR]
    wide = df.agg(*[F.count_if(c).alias(f"c{i}") for i, (c, _) in enumerate(built)])
    rows = [F.struct(F.lit(t).alias("description"), F.col(f"c{i}").alias("n")) for i, (_, t) in enumerate(built)]
    return wide.select(F.inline(F.array(*rows)))


@query("f9_and", sql(f"SELECT id, CAST(coalesce(price > 950, false) AND size IS DISTINCT FROM 10 AS INTEGER) AS hit FROM {V}", V))
def _(s, d):
    df = view(s, d, V)
    return df.select("id", cond.combine(PAIR, df.columns, "and", ALIASES).column.cast("int").alias("hit"))


@query("f9_or", sql(f"SELECT id, CAST(coalesce(price > 950, false) OR size IS DISTINCT FROM 10 AS INTEGER) AS hit FROM {V}", V))
def _(s, d):
    df = view(s, d, V)
    broken = [*PAIR, {"column": "absent", "operator": ">", "value": 1}]
    out = cond.combine(broken, df.columns, "or", ALIASES, on_invalid="skip")
    return df.select("id", out.column.cast("int").alias("hit"))


@query(
    "f10_parent",
    sql("SELECT id, CAST(price > 30000 AND returned = 1 AS INTEGER) AS hit, qty FROM line_features", "line_features", doubles="qty"),
)
def _(s, d):
    df = view(s, d, "line_features")
    member, _ = cond.restrict_to_parent(cond.predicate(F.col("price"), ">", 30000), "returned", df.columns)
    return df.select("id", member.cast("int").alias("hit"), "qty")


# --- subsets --------------------------------------------------------------------------------------

SUBSETS = [
    {
        "name": "heavy", "parent_domain": "returned", "logic": "and",
        "conditions": [{"column": "quantity", "operator": ">", "value": 30}, {"column": "price", "operator": "between", "value": [20000, 60000]}],
    },
    {"name": "cheap", "parent_domain": "is_open", "logic": "or", "conditions": [{"column": "price", "operator": "<", "value": 5000}, {"column": "disc", "operator": ">=", "value": 0.09}]},
    {"name": "even", "parent_domain": None, "logic": "and", "conditions": [{"column": "tax", "operator": "in", "value": [0.02, 0.04]}]},
]
SUBSET_ALIASES = {"quantity": ["quantity", "qty"]}
SUBSET_CTE = """flagged AS (SELECT *, CAST(qty > 30 AND price BETWEEN 20000 AND 60000 AND returned = 1 AS INTEGER) AS heavy,
CAST((price < 5000 OR disc >= 0.09) AND is_open = 1 AS INTEGER) AS cheap,
CAST(tax IN (0.02, 0.04) AS INTEGER) AS even FROM line_features)"""


@query("l12_flags", sql("SELECT id, price, heavy, cheap, even FROM flagged", "line_features", ctes=SUBSET_CTE, doubles="price"))
def _(s, d):
    return sub.flag_subsets(view(s, d, "line_features"), SUBSETS, SUBSET_ALIASES)[0].select("id", "price", "heavy", "cheap", "even")


def _subset_row(name: str, parent: str | None, text: str) -> str:
    cand = f"count_if({parent} = 1)" if parent else "count(*)"
    shown = f"'{parent}'" if parent else "NULL"
    return f"""SELECT '{name}' AS subset, {shown} AS parent, {cand}::BIGINT AS candidates, count_if({name} = 1)::BIGINT AS members,
    round(100.0::DOUBLE * count_if({name} = 1) / {cand}, 2) AS percent, '{text}' AS conditions FROM flagged"""


@query(
    "l13_report",
    sql(
        _subset_row("heavy", "returned", "qty > 30; price BETWEEN 20000 AND 60000")
        + " UNION ALL " + _subset_row("cheap", "is_open", "price < 5000; disc >= 0.09")
        + " UNION ALL " + _subset_row("even", None, "tax IN [0.02, 0.04]"),
        "line_features", ctes=SUBSET_CTE, doubles="percent",
    ),
)
def _(s, d):
    df, plan = sub.flag_subsets(view(s, d, "line_features"), SUBSETS, SUBSET_ALIASES)
    return sub.subset_report(df, plan)


@query(
    "l13_statistics",
    sql(
        " UNION ALL ".join(
            f"SELECT '{n}' AS subset, '{c}' AS \"column\", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max FROM flagged WHERE {n} = 1"
            for n in ("heavy", "cheap", "even") for c in ("qty", "price", "disc", "tax")
        ),
        "line_features", ctes=SUBSET_CTE, doubles="mean std min max",
    ),
)
def _(s, d):
    df, _ = sub.flag_subsets(view(s, d, "line_features"), SUBSETS, SUBSET_ALIASES)
    return sub.subset_statistics(df, ["heavy", "cheap", "even"], ["qty", "price", "disc", "tax"])


# --- flagship: order lines per part -> derive -> label -> flag -> report -----------------------------

FLAGSHIP = {
    "feature_engineering": {
        "features": [
            {"name": "unit_price", "operation": "ratio", "columns": ["revenue", "quantity"]},
            {"name": "markup", "operation": "ratio", "columns": ["unit_price", "p_retailprice"]},
        ]
    },
    "domain_labeling": {
        "text_columns": ["p_name", "p_type"],
        "domains": {"hardware": {"keywords": ["bolt", "gear", "ring"]}, "small": {"keywords": ["small", "economy"]}},
    },
    "domain_subsets": {
        "column_aliases": {"cost": ["p_retailprice"]},
        "subsets": [
            {"name": "busy_hardware", "parent_domain": "hardware", "logic": "and", "conditions": [
                {"column": "quantity", "operator": ">", "value": 700}, {"column": "markup", "operator": ">", "value": 1.0}]},
            {"name": "dear", "parent_domain": None, "logic": "or", "conditions": [
                {"column": "cost", "operator": ">=", "value": 1500}, {"column": "p_size", "operator": "not_in", "value": [1, 2, 3, 4, 5]}]},
        ],
    },
}
_METAL = " OR ".join(f"contains(lower(concat(p_name, ' ', p_type)), '{w}')" for w in ("bolt", "gear", "ring"))


@query(
    "flagship_subsets",
    sql(
        """SELECT 'busy_hardware' AS subset, 'hardware' AS parent, count_if(metal)::BIGINT AS candidates, count_if(busy)::BIGINT AS members,
        coalesce(round(100.0::DOUBLE * count_if(busy) / nullif(count_if(metal), 0), 2), 0) AS percent,
        'quantity > 700; markup > 1.0' AS conditions FROM f
        UNION ALL SELECT 'dear', NULL, count(*), count_if(dear)::BIGINT, round(100.0::DOUBLE * count_if(dear) / count(*), 2),
        'p_retailprice >= 1500; p_size NOT IN [1, 2, 3, 4, 5]' FROM f""",
        ctes=f"""lines AS (SELECT l_partkey, sum(l_quantity) AS quantity, sum(l_extendedprice) AS revenue FROM lineitem GROUP BY l_partkey),
        f AS (SELECT *, metal AND quantity > 700 AND revenue / quantity / p_retailprice > 1.0 AS busy,
        p_retailprice >= 1500 OR p_size NOT IN (1, 2, 3, 4, 5) AS dear
        FROM (SELECT *, {_METAL} AS metal FROM part JOIN lines ON p_partkey = l_partkey))""",
        doubles="percent",
    ),
)
def _(s, d):
    lines = table(s, d, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("revenue")
    )
    parts = table(s, d, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"))
    result = derive_label_flag(parts, FLAGSHIP)
    return sub.subset_report(result.df, result.subsets)
