"""Queries of profiles, correlation, PCA and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as pr
from ..operators import stats as st
from .base import query, sql, table, view

V, L, R, S = "dirty_part", "line_features", "rule_truth", "scored_features"
NUM = ("price", "size", "const", "price2")
FEATS = ("qty", "price", "disc", "tax")
LABELS = ("returned", "is_open", "bulk")


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


_TYPES = {"id": "bigint", "brand": "string", "sparse": "string", "price": "double", "size": "double", "const": "double"}


def _column_row(c: str, kind: str) -> str:
    num = kind != "string"
    f = lambda e: e.format(c=c) if num else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{c}' AS "column", '{kind}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls,
    (count(*) - count({c})) * 100 / CAST(count(*) AS DOUBLE) AS null_pct, count(DISTINCT {c}) AS n_distinct,
    {f('CAST(min({c}) AS DOUBLE)')} AS min, {f('CAST(max({c}) AS DOUBLE)')} AS max, {f('avg({c})')} AS mean,
    {f('stddev_samp({c})')} AS std, {f('CAST(median({c}) AS DOUBLE)')} AS median FROM {V}"""


@query("a2_columns", sql(_union(_column_row(c, k) for c, k in _TYPES.items()), V, doubles="null_pct min max mean std median"))
def _(s, d):
    return pr.column_statistics(view(s, d, V).select(*_TYPES))


def _feature_row(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing,
    (count(*) - count({c})) * 100 / CAST(count(*) AS DOUBLE) AS missing_pct, avg({c}) AS mean, stddev_samp({c}) AS std,
    min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.25) AS q25, median({c}) AS median, quantile_cont({c}, 0.75) AS q75 FROM {V}"""


@query("a3_features", sql(_union(map(_feature_row, NUM)), V, doubles="missing_pct mean std min max q25 median q75"))
def _(s, d):
    return pr.feature_statistics(view(s, d, V), NUM)


@query(
    "a4_missing",
    sql(
        _union(
            f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
            (count(*) - count({c})) * 100 / CAST(count(*) AS DOUBLE) AS missing_pct FROM {V}"""
            for c in ("id", "price", "size", "brand", "size_txt", "name", "kind", "const", "quasi", "sparse", "price2")
        ),
        V, doubles="missing_pct",
    ),
)
def _(s, d):
    return pr.missing_summary(view(s, d, V))


@query(
    "a5_by_label",
    sql(
        _union(
            f"""SELECT '{n}' AS label, '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, coalesce(stddev_samp({c}), 0) AS std,
            min({c}) AS min, max({c}) AS max, median({c}) AS median FROM {L} WHERE {w}"""
            for n, w in (("overall", "true"), *[(x, f"{x} = 1") for x in LABELS])
            for c in FEATS
        ),
        L, doubles="mean std min max median",
    ),
)
def _(s, d):
    return pr.statistics_by_label(view(s, d, L), FEATS, LABELS)


@query("a6_balance", sql(f"SELECT bulk AS value, count(*) AS n FROM {L} GROUP BY bulk", L))
def _(s, d):
    return pr.class_balance(view(s, d, L), "bulk")


@query(
    "a7_label_shares",
    sql(_union(f"SELECT '{n}' AS label, sum({n})::BIGINT AS n, avg({n}) * 100 AS percent FROM {L}" for n in LABELS), L, doubles="percent"),
)
def _(s, d):
    return pr.label_shares(view(s, d, L), LABELS)


def _hist(c: str, bins: int, source: str, where: str = "true", extra: str = "") -> str:
    return f"""SELECT {extra}'{c}' AS feature, b AS bin, e0 AS lo, e1 AS hi, count(x) AS n FROM
    (SELECT CAST(b AS INTEGER) AS b, lo + b * ((hi - lo) / {bins}) AS e0,
     CASE WHEN b = {bins - 1} THEN hi ELSE lo + (b + 1) * ((hi - lo) / {bins}) END AS e1
     FROM (SELECT min({c}) lo, max({c}) hi FROM {source} WHERE {where}), (SELECT unnest(range({bins})) AS b))
    LEFT JOIN (SELECT {c} AS x FROM {source} WHERE {where}) ON x >= e0 AND (x < e1 OR (b = {bins - 1} AND x <= e1))
    GROUP BY b, e0, e1"""


@query("a8_histogram", sql(_union(_hist(c, 50, V) for c in ("price", "size")), V, doubles="lo hi"))
def _(s, d):
    return pr.histograms(view(s, d, V), ["price", "size"], 50)


@query(
    "a9_two_group",
    sql(
        _union(
            _hist("n_chars", 20, S, f"label = 0 AND prediction = {p}", f"'{o}' AS outcome, ") for o, p in (("FP", 1), ("TN", 0))
        ),
        S, doubles="lo hi",
    ),
)
def _(s, d):
    from ..operators.evaluate import outcome

    rows = view(s, d, S).withColumn("outcome", outcome()).filter(F.col("outcome").isin("FP", "TN"))
    return pr.histograms(rows, ["n_chars"], 20, ["outcome"])


@query(
    "a9_probability_by_class",
    sql(_union(_hist("probability", 20, S, f"label = {y}", f"{y} AS label, ") for y in (0, 1)), S, doubles="lo hi"),
)
def _(s, d):
    return pr.histograms(view(s, d, S), ["probability"], 20, ["label"])


@query(
    "a9_many_groups",
    sql(
        """SELECT supplier, 'price' AS feature, b::INTEGER AS bin, any_value(e0) AS lo, any_value(e1) AS hi, count(x) AS n FROM (
        SELECT supplier, b, lo + b * ((hi - lo) / 10) AS e0, CASE WHEN b = 9 THEN hi ELSE lo + (b + 1) * ((hi - lo) / 10) END AS e1 FROM
        (SELECT l_suppkey AS supplier, CASE WHEN min(l_extendedprice) = max(l_extendedprice) THEN min(l_extendedprice) - 0.5 ELSE min(l_extendedprice) END::DOUBLE AS lo,
         CASE WHEN min(l_extendedprice) = max(l_extendedprice) THEN max(l_extendedprice) + 0.5 ELSE max(l_extendedprice) END::DOUBLE AS hi FROM lineitem GROUP BY l_suppkey),
        (SELECT unnest(range(10)) AS b)) g
        LEFT JOIN (SELECT l_suppkey, l_extendedprice::DOUBLE AS x FROM lineitem) v ON l_suppkey = supplier AND x >= e0 AND (x < e1 OR (b = 9 AND x <= e1))
        GROUP BY supplier, b""",
        doubles="lo hi",
    ),
)
def _(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_extendedprice").alias("price"))
    return pr.histograms(rows, ["price"], 10, ["supplier"])


_DOMAIN = """coalesce(nullif(concat_ws(' + ', CASE WHEN returned = 1 THEN 'Returned' END, CASE WHEN is_open = 1 THEN 'Is Open' END,
CASE WHEN bulk = 1 THEN 'Bulk' END), ''), 'Unlabeled')"""


@query(
    "a10_distribution",
    sql(
        _union(
            f"""SELECT domain, '{c}' AS "column", count({c}) AS count, min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.25) AS q25,
            median({c}) AS median, quantile_cont({c}, 0.75) AS q75 FROM (SELECT *, {_DOMAIN} AS domain FROM {L}) GROUP BY domain"""
            for c in ("qty", "price")
        ),
        L, doubles="min max q25 median q75",
    ),
)
def _(s, d):
    return pr.distribution_by_combination(view(s, d, L), ["qty", "price"], LABELS)


@query(
    "a11_normalised",
    sql(
        _union(
            f"SELECT {_DOMAIN} AS domain, '{c}' AS feature, ({c} - m) / v AS value FROM {L}, (SELECT avg({c}) m, stddev_samp({c}) v FROM {L})"
            for c in ("qty", "disc")
        ),
        L, doubles="value",
    ),
)
def _(s, d):
    return pr.normalised_long(view(s, d, L), ["qty", "disc"], LABELS)


@query(
    "a12_coverage",
    sql(_union(f"SELECT '{c}' AS endpoint, count({c}) AS with_value, count(*) AS n_rows FROM {R}" for c in ("measured", "typical")), R),
)
def _(s, d):
    return pr.coverage(view(s, d, R), ["measured", "typical"])


@query(
    "a13_pairs",
    sql(
        f"""SELECT id, measured AS "primary", typical AS fallback, round(measured - typical, 3) AS diff,
        CASE WHEN measured IS NULL AND typical IS NOT NULL THEN 'lab@20C MISSING - only typical available' END AS note FROM {R}""",
        R, doubles="primary fallback diff",
    ),
)
def _(s, d):
    return pr.value_pairs(view(s, d, R), "id", "measured", "typical")


@query(
    "a14_log_hist",
    sql(
        f"""SELECT origin, CAST(b AS INTEGER) AS bin, count(*) AS n FROM (SELECT origin, log10(greatest(measured, 0.05)) AS x FROM {R}
        WHERE measured IS NOT NULL) JOIN (SELECT unnest(range(19)) AS b)
        ON x >= -1.2::DOUBLE + b * (4.8::DOUBLE / 19) AND x < -1.2::DOUBLE + (b + 1) * (4.8::DOUBLE / 19) GROUP BY origin, b""",
        R,
    ),
)
def _(s, d):
    return pr.log_histogram(view(s, d, R), "measured", "origin")


@query(
    "a15_region",
    sql(f"SELECT CASE WHEN bulk = 1 THEN 'Bulk' WHEN returned = 1 THEN 'Back' WHEN is_open = 1 THEN 'Open' ELSE 'other' END AS region, count(*) AS n FROM {L} GROUP BY 1", L),
)
def _(s, d):
    r = pr.region([("bulk", "Bulk"), ("returned", "Back"), ("is_open", "Open")])
    return view(s, d, L).groupBy(r.alias("region")).agg(F.count("*").alias("n"))


# --- correlation -----------------------------------------------------------------------------------


def _corr(a: str, b: str, source: str) -> str:
    const = f"stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) = 0 OR stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END) = 0"
    value = f"CASE WHEN stddev_samp({a}) > 0 THEN 1.0::DOUBLE END" if a == b else f"CASE WHEN {const} THEN NULL ELSE corr({a}, {b}) END"
    return value


@query(
    "c1_corr",
    sql(
        _union(f"SELECT '{a}' AS a, '{b}' AS b, {_corr(a, b, V)} AS r FROM {V}" for a in NUM for b in NUM),
        V, doubles="r",
    ),
)
def _(s, d):
    return st.correlation_matrix(view(s, d, V), NUM).select("a", "b", "r")


@query(
    "c2_pairs",
    sql(
        "SELECT * FROM (" + _union(f"SELECT '{a}' AS a, '{b}' AS b, {_corr(a, b, V)} AS r FROM {V}" for i, a in enumerate(NUM) for b in NUM[i + 1:]) + ") WHERE abs(r) > 0.7",
        V, doubles="r",
    ),
)
def _(s, d):
    return st.high_pairs(st.correlation_matrix(view(s, d, V), NUM), NUM, 0.7)


@query(
    "c3_corr_by_label",
    sql(
        _union(
            f"SELECT '{n}' AS label, count(*) AS n, '{a}' AS a, '{b}' AS b, {_corr(a, b, L)} AS r FROM {L} WHERE {w}"
            for n, w in (("overall", "true"), *[(x, f"{x} = 1") for x in LABELS])
            for a in FEATS for b in FEATS
        ),
        L, doubles="r",
    ),
)
def _(s, d):
    return st.correlation_by_label(view(s, d, L), FEATS, LABELS)


# --- scaling and PCA --------------------------------------------------------------------------------


@query(
    "c4_scale",
    sql(
        f"SELECT id, (qty - m) / v AS qty, price FROM {L}, (SELECT avg(qty) m, stddev_pop(qty) v FROM {L})", L, doubles="qty price"
    ),
)
def _(s, d):
    return st.scale(view(s, d, L), ["qty"]).select("id", "qty", "price")


@query(
    "c5_pca2",
    sql(
        f"""SELECT 1 AS component, (1 + abs(r)) / 2 AS ratio, (1 + abs(r)) / 2 AS cumulative FROM (SELECT corr(qty, price) r FROM {L})
        UNION ALL SELECT 2, (1 - abs(r)) / 2, 1.0::DOUBLE FROM (SELECT corr(qty, price) r FROM {L})""",
        L, doubles="ratio cumulative",
    ),
)
def _(s, d):
    df = view(s, d, L)
    return st.fit_pca(df, ["qty", "price"], 2).variance(df)


# All components together give the correlation matrix back.
@query(
    "c5_pca",
    sql(_union(f"SELECT '{a}' AS a, '{b}' AS b, {_corr(a, b, L)} AS r FROM {L}" for i, a in enumerate(FEATS) for b in FEATS[i:]), L, doubles="r"),
)
def _(s, d):
    df = view(s, d, L)
    fitted = st.fit_pca(df, FEATS, len(FEATS))
    x = fitted.loading_table(df).join(fitted.variance(df).select("component", "ratio"), "component")
    y = x.select("component", F.col("feature").alias("b"), F.col("loading").alias("_l"))
    place = F.create_map(*[v for i, c in enumerate(FEATS) for v in (F.lit(c), F.lit(i))])
    both = x.withColumnRenamed("feature", "a").join(y, "component").filter(place[F.col("a")] <= place[F.col("b")])
    return both.groupBy("a", "b").agg(F.sum(F.col("loading") * F.col("_l") * F.col("ratio") * len(FEATS)).alias("r"))


# With two standardised features the first component is their sum (r > 0) or difference over sqrt(2).
@query(
    "c6_projection",
    sql(
        f"""SELECT id, returned, price, CASE WHEN r > 0 THEN (zq + zp) / sqrt(2) ELSE (zq - zp) / sqrt(2) END AS pc1
        FROM (SELECT *, (qty - mq) / vq AS zq, (price - mp) / vp AS zp FROM {L},
        (SELECT avg(qty) mq, stddev_pop(qty) vq, avg(price) mp, stddev_pop(price) vp, corr(qty, price) r FROM {L}))""",
        L, doubles="price pc1",
    ),
)
def _(s, d):
    df = view(s, d, L)
    return st.pca_points(df, st.fit_pca(df, ["qty", "price"], 2), ["id", "returned", "price"]).drop("pc2")


# --- similarity --------------------------------------------------------------------------------------

P = 64
E = [f"e{i}" for i in range(1, P + 1)]


def vectors(s, d):
    df = table(s, d, "embeddings")
    return df.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(E)])


_Z = f"""e AS (SELECT vec_id, label, {', '.join(f'CAST(embedding[{i}] AS DOUBLE) AS e{i}' for i in range(1, P + 1))} FROM embeddings),
m AS (SELECT {', '.join(f'avg({c}) AS m{c}, stddev_pop({c}) AS s{c}' for c in E)} FROM e),
z AS (SELECT vec_id, label, [{', '.join(f'({c} - m{c}) / s{c}' for c in E)}] AS z FROM e, m),
pairs AS (SELECT a.label, list_cosine_similarity(a.z, b.z) AS cosine, 1 / (1 + list_distance(a.z, b.z)) AS euclidean
FROM z a JOIN z b ON a.label = b.label AND a.vec_id <> b.vec_id)"""


@query(
    "c7_cosine",
    sql(
        """SELECT label, CAST((1 + sqrt(1 + 4 * count(*))) / 2 AS BIGINT) AS n, avg(cosine) AS cosine_mean, stddev_pop(cosine) AS cosine_std
        FROM pairs GROUP BY label""",
        ctes=_Z, doubles="cosine_mean cosine_std",
    ),
)
def _(s, d):
    return st.cosine_similarity(vectors(s, d), "label", E)


_GROUPS = {"low": "label <= 4", "odd": "label % 2 = 1"}
_ZG = _Z.split("pairs AS")[0].rstrip().rstrip(",")


@query(
    "c10_comparison",
    sql(
        _union(
            f"""SELECT '{n}' AS label, CAST((1 + sqrt(1 + 4 * count(*))) / 2 AS BIGINT) AS n, avg(c) AS cosine_mean, stddev_pop(c) AS cosine_std,
            avg(u * u) AS squared_distance_mean FROM (SELECT list_cosine_similarity(a.z, b.z) AS c,
            list_distance(a.z, b.z) AS u FROM (SELECT * FROM z WHERE {w}) a JOIN (SELECT * FROM z WHERE {w}) b ON a.vec_id <> b.vec_id)"""
            for n, w in _GROUPS.items()
        ),
        ctes=_ZG, doubles="cosine_mean cosine_std squared_distance_mean",
    ),
)
def _(s, d):
    df = vectors(s, d).withColumns({n: F.expr(f"CAST({w} AS INT)") for n, w in _GROUPS.items()})
    return st.similarity_comparison(df, list(_GROUPS), E)
