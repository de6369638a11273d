"""Measured values from semi-structured documents.

Lines carry the few lines after them, so every search is a test on one row; the first hit of each
(document, endpoint) is a min aggregate that combines on the map side. Documents of one row need no
shuffle before it. Of documents of many pages the lines whose look-ahead leaves their page are shuffled,
and the first lines of each page, in overlapping blocks of pages.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.nulls import as_column, strip
from ..functions.order import SMALL_ROWS, null_safe_join, running_sums
from ..session import checkpointed

# Line ends, number, quality code, search distances and key words.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"
NUMBER = r"-?\d+(?:\.\d+)?"
CODE = r"\b([A-Z]{1,3}\d)\b"
NEXT_LINES = 6
BLOCK_LINES = 9
BLOCK_RANGE = (-12.0, 12.0)
ESTIMATE_WORDS = r"(?i)calculat|estimat|predicted|QSAR"
LEVEL_WORDS = r"\b(Low|Moderate|High|Very)\b"
SCIENTIFIC = r"-?\d+(?:\.\d+)?\s*X\s*10\S*"

_LOOKAHEAD = max(NEXT_LINES, BLOCK_LINES - 1)
_BLOCK = 1000
#: Texts of a task. What is found in them is sorted by document before it is sent on, which holds it in memory.
TEXTS_PER_TASK = 50_000


@dataclass(frozen=True)
class Endpoint:
    """``kind``: 'same_line', 'next_line', 'coded_line' or 'block' (then ``anchor``/``fallback`` are plain texts)."""

    name: str
    kind: str
    anchor: str
    fallback: str | None = None


# The endpoints of the two document layouts, with their anchors.
PAGED_ENDPOINTS = (
    Endpoint("WaterSolubility_mgL", "next_line", r"In water at 20"),
    Endpoint("LogKow", "same_line", r"Log P\b"),
    Endpoint("Koc_Lkg", "same_line", r"Koc \("),
    Endpoint("BCF_Lkg", "same_line", r"BCF \("),
    Endpoint("DT50_soil_d", "next_line", r"DT.{0,3}\s*\(lab at 20"),
    Endpoint("DT50_soil_typical", "same_line", r"DT.{0,3}\s*\(typical\)"),
    Endpoint("DT50_water_d", "same_line", r"Water-sediment DT.{0,3}\s*\(days\)"),
)
CODED_ENDPOINTS = (
    Endpoint("WaterSolubility_mgL", "coded_line", r"In water at 20"),
    Endpoint("LogKow", "block", "Octanol-water", "Log P"),
    Endpoint("Koc_Lkg", "coded_line", r"Koc \("),
    Endpoint("BCF_Lkg", "coded_line", r"BCF \("),
    Endpoint("DT50_soil_d", "coded_line", r"DT.{0,3}\s*\(lab at 20"),
    Endpoint("DT50_soil_typical", "coded_line", r"DT.{0,3}\s*\(typical\)"),
    Endpoint("DT50_water_d", "coded_line", r"Water-sediment DT.{0,3}\s*\(days\)"),
)

# Unit, method and species written beside a value.
FIELDS = {
    "WaterSolubility_mgL": ("mg/L", "water 20C pH7", None),
    "BCF_Lkg": ("L/kg", None, "fish whole body"),
    "Koc_Lkg": ("mL/g=L/kg", "Koc", None),
    "DT50_soil_d": ("days", "lab 20C aerobic", None),
    "DT50_water_d": ("days", "water-sediment", None),
    "LogKow": ("log", "Kow pH7 20C", None),
}


# --- lines ----------------------------------------------------------------------------------------


def split_lines(text: Column) -> Column:
    """Array of lines; a final line end opens no new line and empty text has none."""
    body = F.regexp_replace(text, rf"(?:{LINE_END})\z", "")
    return F.when(F.length(text) > 0, F.split(body, LINE_END, -1)).otherwise(F.array().cast("array<string>"))


def page_number(name: Column) -> Column:
    """First run of digits of a page's name."""
    return F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")).cast("int")


def document_lines(df: DataFrame, doc: str, text: str, page: str | None = None) -> DataFrame:
    """(doc_id, page, line_no, text), line numbers from 1 on each page."""
    number = as_column(page).cast("int") if page else F.lit(1)
    return df.select(
        as_column(doc).alias("doc_id"), number.alias("page"), F.posexplode(split_lines(as_column(text))).alias("_i", "text")
    ).select("doc_id", "page", (F.col("_i") + 1).alias("line_no"), "text")


def lines_with_following(
    df: DataFrame, doc: str, text: str, page: str | None = None, wanted: str | None = None, after: int = _LOOKAHEAD
) -> DataFrame:
    """Lines with ``following``: the next ``after`` lines of the document, across pages.

    ``wanted`` is a pattern; only lines that match it are returned, and only pages that hold such a
    line are taken apart. ``df`` has one row per document, or per page with ``page``.
    """
    number = as_column(page).cast("int") if page else F.lit(1)
    pages = df.select(as_column(doc).alias("doc_id"), number.alias("page"), as_column(text).alias("_t"))
    rows = pages.filter(F.col("_t").rlike(wanted) if wanted else F.length("_t") > 0)
    rows = rows.withColumn("_lines", split_lines(F.col("_t"))).drop("_t")
    own = F.transform("_lines", lambda x, i: F.struct(F.col("page").alias("page"), (i + 1).alias("line_no"), x.alias("text")))
    rows = rows.withColumn("_own", own)
    hits = F.filter("_own", lambda x: x["text"].rlike(wanted)) if wanted else F.col("_own")
    placed = F.transform(
        hits,
        lambda x: F.struct(
            x["page"].alias("page"),
            x["line_no"].alias("line_no"),
            x["text"].alias("text"),
            F.slice("_own", x["line_no"] + 1, F.lit(after)).alias("following"),
        ),
    )
    found = rows.select("doc_id", F.inline(placed))
    if page is None:
        return found
    # A line whose look-ahead ends on its own page is done. Of the others only the line and what follows it there
    # travel, to meet the first lines of the next pages.
    found = checkpointed(found)
    short = F.size("following") < after
    opened = null_safe_join(found.filter(short), _following_heads(pages, after), ["doc_id", "page"], large=True)
    closed_now = F.concat("following", F.slice("_next", 1, F.lit(after) - F.size("following")))
    return found.filter(~short).unionByName(opened.withColumn("following", closed_now).drop("_next"))


def _following_heads(pages: DataFrame, after: int) -> DataFrame:
    """Per page the first ``after`` lines that come after it in its document.

    Only the first lines of each page move. Pages are numbered along the document and cut into
    blocks that overlap by ``after`` pages (every page with text has a line), so a document of very
    many pages is spread over tasks.
    """
    heads = pages.filter(F.length("_t") > 0).select(
        "doc_id", "page", F.slice(split_lines(F.col("_t")), 1, after).alias("_head")
    )
    index = running_sums(
        heads.groupBy("doc_id", "page").agg(F.count("*").alias("one")), "page", ["one"], by=["doc_id"], spread=heads
    ).select("doc_id", "page", (F.col("cum_one") - 1).alias("_i"))
    head = F.transform("_head", lambda x, i: F.struct(F.col("page").alias("page"), (i + 1).alias("line_no"), x.alias("text")))
    placed = null_safe_join(heads.select("doc_id", "page", head.alias("_head")), index, ["doc_id", "page"], large=True)
    block = F.floor(F.col("_i") / _BLOCK)
    copies = F.when((F.col("_i") % _BLOCK < after) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    window = Window.partitionBy("doc_id", "_block").orderBy("_i").rowsBetween(1, after)
    return (
        placed.withColumn("_home", block)
        .withColumn("_block", F.explode(copies))
        .withColumn("_next", F.slice(F.flatten(F.collect_list("_head").over(window)), 1, after))
        .filter(F.col("_block") == F.col("_home"))
        .select("doc_id", "page", "_next")
    )


# --- one candidate per line and endpoint -------------------------------------------------------------


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"({NUMBER})", 1), F.lit("")).cast("double")


def without_anchor(text: Column, anchor: str) -> Column:
    """The line with the first match of the anchor taken out."""
    return F.regexp_replace(text, rf"(?s)^(.*?)(?:{anchor})", "$1")


def number_and_code(tail: Column) -> tuple[Column, Column]:
    """First plain number (scientific 'n X 10..' is skipped) and the first quality code after it."""
    plain = F.when(tail.rlike(r"X\s*10"), F.regexp_replace(tail, SCIENTIFIC, " ")).otherwise(tail)
    rest = F.regexp_extract(plain, rf"(?s)^.*?(?:{NUMBER})(.*)$", 1)
    return first_number(plain), F.nullif(F.regexp_extract(rest, CODE, 1), F.lit(""))


def _hits(endpoints: Sequence[Endpoint]) -> Column:
    """Array of (endpoint, kind, tail) for every anchor the line holds; the tail lacks the anchor."""
    text = F.col("text")

    def hit(test: Column, name: str, kind: str, tail: Column) -> Column:
        return F.when(test, F.struct(F.lit(name).alias("endpoint"), F.lit(kind).alias("kind"), tail.alias("tail")))

    cells = []
    for e in endpoints:
        if e.kind == "block":
            fallback = e.fallback or e.anchor
            cells += [hit(text.contains(e.anchor), e.name, "header", text), hit(text.contains(fallback), e.name, "fallback", text)]
        elif e.kind in ("same_line", "coded_line"):
            cells.append(hit(text.rlike(e.anchor), e.name, e.kind, without_anchor(text, e.anchor)))
        elif e.kind == "next_line":
            cells.append(hit(text.rlike(e.anchor), e.name, e.kind, text))
        else:
            raise ValueError(f"unknown endpoint kind: {e.kind}")
    return F.array_compact(F.array(*cells))


_BLOCK_VALUE = rf"({NUMBER})\s+([A-Z]{{1,3}}\d)\b"


def _block_line(x: Column) -> Column:
    """A line of a block that carries the value: a level word, and a number in range before a code."""
    t = x["text"]
    value = F.nullif(F.regexp_extract(t, _BLOCK_VALUE, 1), F.lit("")).cast("double")
    return (
        t.rlike(LEVEL_WORDS)
        & ~t.contains("X 10")
        & ~t.contains("Calculated")
        & F.coalesce(value.between(*BLOCK_RANGE), F.lit(False))
    )


def _next_value_line(x: Column) -> Column:
    """A number starts the line, or its first word is a dash, or it holds nothing but dashes."""
    return strip(x["text"]).rlike(r"^(?:-?\d|-{1,3}(?:\s|$)|[- ]+$)")


def _records(hits: DataFrame) -> DataFrame:
    """One ranked record per hit: 0 found, 1 block header without value, 2 found under a fallback.

    ``mark`` is the place of a fallback anchor, which tells 'no data' when nothing is found.

    Each stage is a projection of its own, so that a search is evaluated once per hit.
    """
    kind = F.col("kind")
    block = kind.isin("header", "fallback")
    own = F.array(F.struct(F.col("page"), F.col("line_no"), F.col("text")))
    nearby = (
        F.when(kind == "next_line", F.filter(F.slice("following", 1, NEXT_LINES), _next_value_line))
        .when(block, F.filter(F.concat(own, F.slice("following", 1, BLOCK_LINES - 1)), _block_line))
    )
    code, plain_value = number_and_code(F.col("tail"))[1], first_number(F.col("tail"))
    staged = hits.withColumn("near", F.get(nearby, F.lit(0)))
    staged = staged.withColumn("spot", strip(F.coalesce(F.col("near.text"), F.col("text"))))
    staged = staged.withColumn(
        "value",
        F.when(kind == "same_line", plain_value)
        .when(kind == "coded_line", number_and_code(F.col("tail"))[0])
        .when(kind == "next_line", F.when(F.col("spot").rlike(r"^-?\d"), first_number(F.col("spot"))))
        .when(F.col("near").isNotNull(), F.regexp_extract("spot", _BLOCK_VALUE, 1).cast("double")),
    )
    has = F.col("value").isNotNull()
    found = F.col("near").isNotNull()
    staged = staged.withColumn(
        "qc",
        F.when((kind == "coded_line") & has, code).when(block & found, F.regexp_extract("spot", _BLOCK_VALUE, 2)),
    )
    empty = F.col("tail").rlike(r"^\s*-*\s*$")
    rank = (
        F.when(kind == "same_line", F.when(has | empty, 0))
        .when(kind == "coded_line", 0)
        .when(kind == "next_line", F.when(found, 0))
        .when(kind == "header", F.when(found, 0).otherwise(1))
        .otherwise(F.when(found, 2))
    )
    return staged.select(
        "doc_id",
        "endpoint",
        F.struct(
            rank.alias("rank"),
            F.col("page").alias("anchor_page"),
            F.col("line_no").alias("anchor_line"),
            F.col("value"),
            F.col("qc"),
            F.coalesce("near.page", "page").cast("int").alias("page"),
            F.coalesce("near.line_no", "line_no").cast("int").alias("line"),
            F.col("spot").alias("raw"),
            F.when(kind == "header", F.lit(False)).otherwise(~has).alias("nodata"),
        ).alias("c"),
        F.when(kind == "fallback", F.struct("page", "line_no", strip("text").alias("raw"))).alias("mark"),
    )  # records without rank are ignored by the aggregate; a filter here would repeat the search


def _wanted_pattern(endpoints: Sequence[Endpoint]) -> str:
    parts = []
    for e in endpoints:
        if e.kind == "block":
            parts += [rf"\Q{t}\E" for t in (e.anchor, e.fallback) if t]
        else:
            parts.append(e.anchor)
    return "|".join(f"(?:{p})" for p in parts)


def _spread(df: DataFrame, doc: str, text: str, page: str | None) -> DataFrame:
    """The texts in tasks of a bounded number, however the files were cut; pages of one document go apart."""
    tasks = math.ceil(df.count() / TEXTS_PER_TASK)
    columns = [as_column(c) for c in (doc, page, text) if c]
    return df.select(*columns).repartition(tasks, *columns) if tasks > 1 else df


def extract(df: DataFrame, doc: str, text: str, endpoints: Sequence[Endpoint], page: str | None = None) -> DataFrame:
    """One record per document and endpoint that occurs: value, qc, page, line, raw, nodata.

    ``df`` has one row per document, or per page with ``page``.
    """
    lines = lines_with_following(_spread(df, doc, text, page), doc, text, page, _wanted_pattern(endpoints))
    hits = lines.select("doc_id", "page", "line_no", "text", "following", F.inline(_hits(endpoints)))
    rank = F.col("c.rank")
    best = _records(hits).groupBy("doc_id", "endpoint").agg(
        F.min(F.when(rank == 0, F.col("c"))).alias("_found"),
        F.count_if(rank == 1).alias("_headers"),
        F.min(F.when(rank == 2, F.col("c"))).alias("_second"),
        F.min("mark").alias("_mark"),
    )
    best = best.withColumn("c", F.coalesce(F.col("_found"), F.when(F.col("_headers") == 0, F.col("_second"))))
    mark = F.col("_mark")
    return best.filter(F.col("c").isNotNull() | mark.isNotNull()).select(
        "doc_id",
        "endpoint",
        "c.value",
        "c.qc",
        F.coalesce("c.page", mark["page"]).alias("page"),
        F.coalesce("c.line", mark["line_no"]).alias("line"),
        F.coalesce("c.raw", mark["raw"]).alias("raw"),
        F.coalesce("c.nodata", F.lit(True)).alias("nodata"),
    )


# --- assembly -----------------------------------------------------------------------------------------


def origin(raw: Column) -> Column:
    """'estimated' when the line says so, else 'measured'."""
    return F.when(F.coalesce(raw.rlike(ESTIMATE_WORDS), F.lit(False)), F.lit("estimated")).otherwise(F.lit("measured"))


def look_up(records: DataFrame, names: DataFrame, key: str, entity: str, preserved: Sequence[str] = ()) -> DataFrame:
    """Records of mapped documents with their entity; entities listed as preserved are left out."""
    wanted = names.select(as_column(key), as_column(entity)).distinct()
    if preserved:
        wanted = wanted.filter(~as_column(entity).isin(list(preserved)))
    return null_safe_join(records, wanted, [key], small=SMALL_ROWS)


def plain_number(x: Column) -> Column:
    """A number as short text: whole numbers without a fraction."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def citation(base: str, code: Column, typical: Column) -> Column:
    """Base text, then '; QC <code>' and '; typical <value>' where they exist."""
    return F.concat_ws(
        "; ",
        F.lit(base),
        F.when(code.isNotNull(), F.concat(F.lit("QC "), code)),
        F.when(typical.isNotNull(), F.concat(F.lit("typical "), plain_number(typical))),
    )


def audit(records: DataFrame, entity: str, file: str, form: str) -> DataFrame:
    """Long trail of every extracted value: entity, endpoint, value, origin, code, file, format, place, raw line."""
    return records.filter(F.col("value").isNotNull()).select(
        as_column(entity).alias("entity"),
        "endpoint",
        "value",
        origin(F.col("raw")).alias("origin"),
        F.coalesce("qc", F.lit("")).alias("qc"),
        as_column(file).alias("source_file"),
        F.lit(form).alias("format"),
        "page",
        "line",
        F.col("raw").alias("raw_line"),
    )


def wide_records(records: DataFrame, entity: str, endpoints: Sequence[str], file: str = "doc_id") -> DataFrame:
    """One row per entity with a record column per endpoint; of several files the last by name counts."""
    record = F.struct("value", "qc", "raw")
    aggs = [
        F.max_by(
            F.when((F.col("endpoint") == e) & F.col("value").isNotNull(), record),
            F.when((F.col("endpoint") == e) & F.col("value").isNotNull(), F.struct(as_column(file))),
        ).alias(e)
        for e in endpoints
    ]
    return records.groupBy(as_column(entity).alias(entity)).agg(*aggs)


def fill(
    template: DataFrame,
    records: DataFrame,
    entity: str,
    source: str,
    cite: str,
    with_code: bool,
    fields: dict[str, tuple[str | None, str | None, str | None]] = FIELDS,
    typical: tuple[str, str] = ("DT50_soil_d", "DT50_soil_typical"),
) -> DataFrame:
    """Write each extracted value and its companions over the template's columns; the rest is kept.

    The typical value of ``typical[0]`` is cited and also written as its own column.
    """
    wide = wide_records(records, entity, [*fields, typical[1]]).withColumnRenamed(entity, "_entity")
    joined = template.join(wide, as_column(entity).eqNullSafe(F.col("_entity")), "left")
    new: dict[str, Column] = {}
    for e, (unit, method, species) in fields.items():
        has = F.col(e).isNotNull()
        code = F.col(f"{e}.qc") if with_code else F.lit(None).cast("string")
        beside = F.col(f"{typical[1]}.value") if e == typical[0] else F.lit(None).cast("double")
        parts = {
            "value": F.col(f"{e}.value"),
            "unit": F.lit(unit).cast("string"),
            "method": F.lit(method).cast("string"),
            "species": F.lit(species).cast("string"),
            "meas_or_est": origin(F.col(f"{e}.raw")),
            "db_source": F.lit(source),
            "primary_citation": citation(cite, code, beside),
        }
        for k, c in parts.items():
            new[f"{e}__{k}"] = F.when(has, c)
    new[f"{typical[0]}__typical_value"] = F.col(f"{typical[1]}.value")
    out = []
    for c in template.columns:
        out.append(F.coalesce(new[c], as_column(c)).alias(c) if c in new else as_column(c))
    out += [c.alias(k) for k, c in new.items() if k not in template.columns]
    return joined.select(*out)


def filled_entities(trail: DataFrame) -> DataFrame:
    return trail.select("entity").distinct().orderBy("entity")

