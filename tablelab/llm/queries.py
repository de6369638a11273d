"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, backoff, chunks, decontaminate, language, licences, maintext, merkle, neardups, packing, quotes, repetitions, toxicity


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.report(_table(spark, sf, "documents"))


def op2_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardups.report(_table(spark, sf, "documents"))


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.report(_table(spark, sf, "documents"))


def op4_quotes(spark: SparkSession, sf: str) -> DataFrame:
    return quotes.report(_table(spark, sf, "conversations"))


def op5_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.report(_table(spark, sf, "documents"))


def op6_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return maintext.report(_table(spark, sf, "pages"))


def op7_backoff(spark: SparkSession, sf: str) -> DataFrame:
    found = backoff.report(_table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 3).alias("mean_log_score"))


def op7_backoff_orders(spark: SparkSession, sf: str) -> DataFrame:
    """All n-grams of up to five words, without the scored place; ``op7_backoff`` is what its SQL twin states."""
    return backoff.report(_table(spark, sf, "documents"), order=backoff.ORDER, least=1, leave_out=True)


def op8_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op9_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.report(_table(spark, sf, "documents"))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.report(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return repetitions.report(_table(spark, sf, "documents"))


def op12_licences(spark: SparkSession, sf: str) -> DataFrame:
    return licences.report(_table(spark, sf, "documents"))


def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.report(_table(spark, sf, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language,
        op2_near_duplicates,
        op3_packing,
        op4_quotes,
        op5_fingerprints,
        op6_main_text,
        op7_backoff,
        op7_backoff_orders,
        op8_decontaminate,
        op9_substrings,
        op10_toxicity,
        op11_periodic_runs,
        op12_licences,
        op13_alignment,
    )
}

#: Words of a text, with A-Z alone lower-cased.
_WORDS = (
    "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)



def _licence_sql() -> str:
    """Every place where a template's key phrases stand, without the index."""
    listed = [(t, x.label, x.base, *word) for t, x in enumerate(licences.TEMPLATES) for word in x.words()]
    values = ", ".join(f"({t}, '{label}', {base}, {at}, '{w}', {key})" for t, label, base, at, w, key in listed)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS ws FROM documents),
parts AS (SELECT * FROM (VALUES {values}) AS v(t, label, base, p, w, key)),
words AS (SELECT * FROM (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM texts) WHERE w IN (SELECT w FROM parts)),
idf AS (SELECT p.w, ln((any_value(t.n) + 1) / (count(d.r) + 1)) + 1 AS weight FROM (SELECT DISTINCT w FROM parts) p
        LEFT JOIN (SELECT DISTINCT r, w FROM words) d USING (w), (SELECT count(*)::DOUBLE AS n FROM texts) t GROUP BY p.w),
sizes AS (SELECT t, any_value(label) AS label, any_value(base) AS base, count_if(key) AS keys, sum(weight) AS whole FROM parts JOIN idf USING (w) GROUP BY t),
found AS (SELECT r, t, i - p AS start, count_if(key) AS keys, sum(weight) AS weight FROM words JOIN parts USING (w) JOIN idf USING (w) GROUP BY ALL),
places AS (SELECT r, start, label, base, f.weight / s.whole AS share FROM found f JOIN sizes s USING (t)
           WHERE f.keys = s.keys AND start >= 0 AND f.weight / s.whole >= {licences.LEAST_SHARE}),
sums AS (SELECT r, count_if(base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         round(max(share), 6) AS score FROM places GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM texts LEFT JOIN sums USING (r)"""


ORACLE: dict[str, str] = {
    "op12_licences": _licence_sql(),
    "op7_backoff": f"""
WITH texts AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS ws FROM documents),
singles AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM texts),
pairs AS (SELECT doc_id, word, place, lag(word) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM singles),
ones AS (SELECT word, count(*) AS n FROM singles GROUP BY word),
twos AS (SELECT before, word, count(*) AS n FROM pairs WHERE before IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
total AS (SELECT count(*) AS n FROM singles),
scored AS (
  SELECT p.doc_id, CASE WHEN p.before IS NULL THEN ln(o.n / t.n) WHEN b.n IS NULL THEN ln(0.4 * o.n / t.n) ELSE ln(b.n / c.n) END AS v
  FROM pairs p JOIN ones o ON o.word = p.word LEFT JOIN twos b ON b.before = p.before AND b.word = p.word
       LEFT JOIN ones c ON c.word = p.before CROSS JOIN total t),
sums AS (SELECT doc_id, count(*) AS n, sum(v) AS s FROM scored GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, round(coalesce(s, 0.0), 3) AS log_score, round(s / n, 3) AS mean_log_score
FROM texts LEFT JOIN sums USING (doc_id)""",
    "op8_decontaminate": f"""
WITH texts AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS ws FROM documents),
items AS (SELECT item_id, coalesce({_WORDS.format("text")}, []) AS ws FROM benchmark),
windows AS (SELECT DISTINCT item_id, array_to_string(ws[k + 1 : k + 13], ' ') AS w, least(len(ws), 13) AS size
            FROM items, unnest(range(greatest(1, len(ws) - 12))) AS u(k) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, size, k, array_to_string(ws[k + 1 : k + size], ' ') AS w
           FROM texts, sizes, unnest(range(greatest(0, len(ws) - size + 1))) AS u(k)),
hits AS (SELECT doc_id, k, p.size, item_id FROM places p JOIN windows USING (w, size)),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(k, k + size)) AS u(j) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM texts LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
}
