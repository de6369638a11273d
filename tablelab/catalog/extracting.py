"""Queries of value extraction from documents and of its assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as ex
from .base import query, sql, table, view
from .profiling import _union

T = "doc_text"
KOC = ex.Endpoint("Koc_Lkg", "same_line", r"Koc \(mL g-1\)")
WATER = ex.Endpoint("WaterSolubility_mgL", "next_line", r"In water at 20")
CODED = ex.Endpoint("Koc_Lkg", "coded_line", r"Koc \(mL g-1\)")
LOGP = ex.Endpoint("LogKow", "block", "Octanol-water", "Log P")
ENDPOINTS = [CODED, WATER, LOGP]

# What the documents were built from, straight from the part table.
_KOC = """SELECT p_partkey AS doc_id, 'Koc_Lkg' AS endpoint, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS value,
{code} AS qc, 1 AS page, 2 AS line, 'Koc (mL g-1) ' || CASE WHEN p_partkey % 5 = 0 THEN '-'
WHEN p_partkey % 3 = 0 THEN p_size || ' Q2 Estimated' ELSE p_size || ' A5 High' END AS raw, p_partkey % 5 = 0 AS nodata FROM part"""
_CODE = "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'Q2' ELSE 'A5' END"
_WATER = """SELECT p_partkey AS doc_id, 'WaterSolubility_mgL' AS endpoint, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS value,
CAST(NULL AS VARCHAR) AS qc, 1 AS page, 5 AS line, CASE WHEN p_partkey % 4 = 0 THEN '--' ELSE CAST(p_retailprice AS VARCHAR) END || ' H4 High' AS raw,
p_partkey % 4 = 0 AS nodata FROM part"""
_V = "CAST((p_size - 25) || '.5' AS DOUBLE)"
_HIT = f"p_partkey % 7 <> 0 AND {_V} BETWEEN -12 AND 12"
_LOGP = f"""SELECT p_partkey AS doc_id, 'LogKow' AS endpoint, CASE WHEN {_HIT} THEN {_V} END AS value,
CASE WHEN {_HIT} THEN 'A5' END AS qc, 1 AS page, 8 AS line,
'Log P ' || CASE WHEN p_partkey % 7 = 0 THEN '-' ELSE (p_size - 25) || '.5' END || ' A5 High' AS raw, NOT ({_HIT}) AS nodata FROM part"""
_ALL = _union([_KOC.format(code=_CODE), _WATER, _LOGP])


@query("s7_lines", sql(f"SELECT doc_id, 1 AS page, CAST(i AS INTEGER) AS line_no, string_split(text, chr(10))[i] AS text FROM {T}, (SELECT unnest(range(1, 9)) AS i)", T))
def _(s, d):
    return ex.document_lines(view(s, d, T), "doc_id", "text")


@query("x1_same_line", sql(f"SELECT * FROM ({_KOC.format(code='CAST(NULL AS VARCHAR)')})", doubles="value"))
def _(s, d):
    return ex.extract(view(s, d, T), "doc_id", "text", [KOC])


@query("x2_next_line", sql(f"SELECT * FROM ({_WATER})", doubles="value"))
def _(s, d):
    return ex.extract(view(s, d, T), "doc_id", "text", [WATER])


def _pages(s, d):
    """The same documents on two pages: the anchor ends page 1, its value follows on page 2."""
    lines = F.split("text", "\n")
    parts = [F.struct(F.lit(i + 1).alias("page"), F.array_join(F.slice(lines, a, n), "\n").alias("text")) for i, (a, n) in enumerate(((1, 3), (4, 9)))]
    return view(s, d, T).select("doc_id", F.inline(F.array(*parts)))


@query("x2_across_pages", sql(f"SELECT * REPLACE (2 AS page, 2 AS line) FROM ({_WATER})", doubles="value"))
def _(s, d):
    return ex.extract(_pages(s, d), "doc_id", "text", [WATER], page="page")


@query("x3_code", sql(f"SELECT * FROM ({_KOC.format(code=_CODE)})", doubles="value"))
def _(s, d):
    return ex.extract(view(s, d, T), "doc_id", "text", [CODED])


@query("x4_block", sql(f"SELECT * FROM ({_LOGP})", doubles="value"))
def _(s, d):
    return ex.extract(view(s, d, T), "doc_id", "text", [LOGP])


@query("x5_endpoints", sql(f"SELECT * FROM ({_ALL})", doubles="value"))
def _(s, d):
    return ex.extract(view(s, d, T), "doc_id", "text", ENDPOINTS)


_VERSION_LINES = """ln AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS t FROM
(SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
hit AS (SELECT doc_id, i, t, regexp_extract(regexp_replace(t, '[Vv]ersion', ''), '(-?\\d+(?:\\.\\d+)?)', 1) AS v,
regexp_full_match(regexp_replace(t, '[Vv]ersion', ''), '\\s*-*\\s*') AS nothing FROM ln WHERE regexp_matches(t, '[Vv]ersion')),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM hit WHERE v <> '' OR nothing)"""


@query(
    "x1_real_text",
    sql(
        "SELECT doc_id, 'version' AS endpoint, CAST(nullif(v, '') AS DOUBLE) AS value, CAST(i AS INTEGER) AS line, v = '' AS nodata FROM f WHERE rn = 1",
        ctes=_VERSION_LINES, doubles="value",
    ),
)
def _(s, d):
    found = ex.extract(table(s, d, "documents"), "doc_id", "text", [ex.Endpoint("version", "same_line", "[Vv]ersion")])
    return found.select("doc_id", "endpoint", "value", "line", "nodata")


@query(
    "x6_flag",
    sql(
        f"SELECT doc_id, CASE WHEN regexp_matches(raw, '(?i)calculat|estimat|predicted|QSAR') THEN 'estimated' ELSE 'measured' END AS origin FROM ({_KOC.format(code=_CODE)})"
    ),
)
def _(s, d):
    return ex.extract(view(s, d, T), "doc_id", "text", [CODED]).select("doc_id", ex.origin(F.col("raw")).alias("origin"))


def _names(s, d):
    """Two of three documents are mapped to an entity of their own."""
    return table(s, d, "part").filter("p_partkey % 3 <> 1").select(
        F.col("p_partkey").alias("doc_id"), F.concat(F.lit("E"), F.col("p_partkey").cast("string")).alias("entity")
    )


def _records(s, d):
    return ex.look_up(ex.extract(view(s, d, T), "doc_id", "text", ENDPOINTS), _names(s, d), "doc_id", "entity", ["E2", "E3"])


_MAPPED = f"mapped AS (SELECT *, 'E' || doc_id AS entity FROM ({_ALL}) WHERE doc_id % 3 <> 1 AND doc_id NOT IN (2, 3))"


@query("x7_lookup", sql("SELECT * FROM mapped", ctes=_MAPPED, doubles="value"))
def _(s, d):
    return _records(s, d)


def _template(s, d):
    return table(s, d, "part").select(
        F.concat(F.lit("E"), F.col("p_partkey").cast("string")).alias("entity"),
        F.col("p_retailprice").alias("Koc_Lkg__value"),
        F.lit("old").alias("Koc_Lkg__db_source"),
    )


_FILL = {"Koc_Lkg": ex.FIELDS["Koc_Lkg"], "WaterSolubility_mgL": ex.FIELDS["WaterSolubility_mgL"]}


@query(
    "x8_fill",
    sql(
        """SELECT t.entity, coalesce(k.value, t.v) AS "Koc_Lkg__value", CASE WHEN k.value IS NOT NULL THEN 'LIT' ELSE 'old' END AS "Koc_Lkg__db_source",
        CASE WHEN k.value IS NOT NULL THEN 'mL/g=L/kg' END AS "Koc_Lkg__unit",
        CASE WHEN k.value IS NOT NULL THEN 'A source; QC ' || k.qc END AS "Koc_Lkg__primary_citation",
        CASE WHEN k.value IS NOT NULL THEN CASE WHEN contains(k.raw, 'Estimated') THEN 'estimated' ELSE 'measured' END END AS "Koc_Lkg__meas_or_est",
        w.value AS "WaterSolubility_mgL__value", CASE WHEN w.value IS NOT NULL THEN 'water 20C pH7' END AS "WaterSolubility_mgL__method",
        CASE WHEN w.value IS NOT NULL THEN 'A source' END AS "WaterSolubility_mgL__primary_citation"
        FROM (SELECT 'E' || p_partkey AS entity, p_retailprice AS v FROM part) t
        LEFT JOIN (SELECT * FROM mapped WHERE endpoint = 'Koc_Lkg' AND value IS NOT NULL) k ON t.entity = k.entity
        LEFT JOIN (SELECT * FROM mapped WHERE endpoint = 'WaterSolubility_mgL' AND value IS NOT NULL) w ON t.entity = w.entity""",
        ctes=_MAPPED, doubles=["Koc_Lkg__value", "WaterSolubility_mgL__value"],
    ),
)
def _(s, d):
    out = ex.fill(_template(s, d), _records(s, d), "entity", "LIT", "A source", with_code=True, fields=_FILL)
    return out.select(
        "entity", "Koc_Lkg__value", "Koc_Lkg__db_source", "Koc_Lkg__unit", "Koc_Lkg__primary_citation", "Koc_Lkg__meas_or_est",
        "WaterSolubility_mgL__value", "WaterSolubility_mgL__method", "WaterSolubility_mgL__primary_citation",
    )


_TRAIL = """SELECT entity, endpoint, value, CASE WHEN contains(raw, 'Estimated') THEN 'estimated' ELSE 'measured' END AS origin,
coalesce(qc, '') AS qc, doc_id AS source_file, '{form}' AS format, page, line, raw AS raw_line FROM mapped WHERE value IS NOT NULL"""


def _trail(s, d):
    r = _records(s, d)
    first, second = r.filter("endpoint = 'Koc_Lkg'"), r.filter("endpoint <> 'Koc_Lkg'")
    return ex.audit(first, "entity", "doc_id", "coded").unionByName(
        ex.audit(second, "entity", "doc_id", "paged"), allowMissingColumns=True
    )


@query(
    "x9_audit",
    sql(
        _TRAIL.format(form="coded") + " AND endpoint = 'Koc_Lkg' UNION ALL " + _TRAIL.format(form="paged") + " AND endpoint <> 'Koc_Lkg'",
        ctes=_MAPPED, doubles="value",
    ),
)
def _(s, d):
    return _trail(s, d)


@query(
    "x10_citation",
    sql(
        """SELECT id, 'A source' || CASE WHEN origin = 'measured' THEN '; QC A5' ELSE '' END
        || CASE WHEN typical IS NOT NULL THEN '; typical ' || CAST(typical AS BIGINT) ELSE '' END AS citation FROM rule_truth""",
        "rule_truth",
    ),
)
def _(s, d):
    code = F.when(F.col("origin") == "measured", F.lit("A5"))
    return view(s, d, "rule_truth").select("id", ex.citation("A source", code, F.col("typical")).alias("citation"))


@query("x11_entities", sql("SELECT DISTINCT entity FROM mapped WHERE value IS NOT NULL", ctes=_MAPPED))
def _(s, d):
    return ex.filled_entities(_trail(s, d))
