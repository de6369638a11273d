"""Registry of runnable queries with their SQL twins, and the views they read.

The views are written once in SQL that Spark and DuckDB both understand; ``{name}`` stands for a
driver table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

VIEWS = {
    "dirty_part": (
        ("part",),
        """
SELECT p_partkey AS id,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS price,
       CASE WHEN p_partkey % 5 = 0 THEN NULL
            WHEN p_partkey % 13 = 0 THEN CAST(-1 AS DOUBLE)
            ELSE CAST(p_size AS DOUBLE) END AS size,
       CASE p_partkey % 11 WHEN 0 THEN 'NA' WHEN 1 THEN '-' WHEN 2 THEN '   '
            WHEN 3 THEN concat('  ', p_brand, ' ') ELSE p_brand END AS brand,
       CASE p_partkey % 9 WHEN 0 THEN 'abc' WHEN 1 THEN '-3.5' WHEN 2 THEN '0'
            ELSE CAST(p_size AS STRING) END AS size_txt,
       CASE WHEN p_partkey % 4 = 0 THEN concat(p_name, '.', p_type) ELSE p_name END AS name,
       p_type AS kind,
       CAST(5 AS DOUBLE) AS const,
       CASE WHEN p_partkey % 1000 = 0 THEN 'b' ELSE 'a' END AS quasi,
       CASE WHEN p_partkey % 20 = 0 THEN 'x' ELSE NULL END AS sparse,
       p_retailprice * 2 + 1 AS price2
FROM {part}""",
    ),
    "line_features": (
        ("lineitem",),
        """
SELECT l_orderkey * 10 + l_linenumber AS id,
       l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned,
       CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_open,
       CASE WHEN l_quantity > 25 AND l_discount < 0.05 THEN 1 ELSE 0 END AS bulk
FROM {lineitem}""",
    ),
    "label_docs": (
        ("documents",),
        """
SELECT doc_id AS id, text AS body, source, lang,
       CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang END AS note
FROM {documents}""",
    ),
    "scored": (
        ("labels",),
        """
SELECT doc_id AS id, quality AS label, toxic AS flag2,
       CAST((doc_id * 37) % 61 + 30 * quality AS DOUBLE) / 90 AS probability,
       CASE WHEN CAST((doc_id * 37) % 61 + 30 * quality AS DOUBLE) / 90 >= 0.5
            THEN 1 ELSE 0 END AS prediction
FROM {labels}""",
    ),
    "scored_features": (
        ("labels", "documents"),
        """
SELECT s.doc_id AS id, s.quality AS label, s.toxic AS flag2,
       CAST((s.doc_id * 37) % 61 + 30 * s.quality AS DOUBLE) / 90 AS probability,
       CASE WHEN CAST((s.doc_id * 37) % 61 + 30 * s.quality AS DOUBLE) / 90 >= 0.5
            THEN 1 ELSE 0 END AS prediction,
       CAST(d.n_chars AS DOUBLE) AS n_chars,
       CAST(s.doc_id % 17 AS DOUBLE) AS bucket
FROM {labels} s JOIN {documents} d ON s.doc_id = d.doc_id""",
    ),
    "rule_truth": (
        ("part",),
        """
SELECT p_partkey AS id,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS measured,
       CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) + 3 ELSE NULL END AS typical,
       CASE WHEN p_partkey % 3 = 0 THEN 'estimated' ELSE 'measured' END AS origin,
       CASE WHEN p_retailprice > 950 THEN 1 ELSE 0 END AS rule_a,
       0 AS rule_never
FROM {part}""",
    ),
    "doc_text": (
        ("part",),
        """
SELECT p_partkey AS doc_id,
       concat('Name ', p_name, chr(10),
              'Koc (mL g-1) ', CASE WHEN p_partkey % 5 = 0 THEN '-'
                                    WHEN p_partkey % 3 = 0 THEN concat(CAST(p_size AS STRING), ' Q2 Estimated')
                                    ELSE concat(CAST(p_size AS STRING), ' A5 High') END, chr(10),
              'In water at 20 C at', chr(10), 'pH 7 (mg l-1)', chr(10),
              CASE WHEN p_partkey % 4 = 0 THEN '--' ELSE CAST(p_retailprice AS STRING) END, ' H4 High', chr(10),
              CASE WHEN p_partkey % 6 = 0 THEN 'Partition' ELSE 'Octanol-water partition coefficient at' END, chr(10),
              'P 1.2 X 10-3 Calculated', chr(10),
              'Log P ', CASE WHEN p_partkey % 7 = 0 THEN '-'
                             ELSE concat(CAST(p_size - 25 AS STRING), '.5') END, ' A5 High') AS text
FROM {part}""",
    ),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    tables, text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf, t) for t in tables})


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to 6 places (and no negative zero), as on the SQL side.

    An exact tie in the 7th place is pushed outwards first, as sums differ in their last bits.
    """
    changed = {
        f.name: F.round(F.col(f"`{f.name}`") + F.col(f"`{f.name}`") * F.lit(1e-12), places) + F.lit(0.0)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(changed) if changed else df


def sql(body: str, *views: str, doubles: Sequence[str] | str = (), ctes: str = "") -> str:
    """SQL twin: the views as CTEs, the body, and the listed double columns rounded."""
    names = doubles.split() if isinstance(doubles, str) else list(doubles)
    parts = []
    for v in views:
        tables, text = VIEWS[v]
        parts.append(f"{v} AS ({text.format(**{t: t for t in tables})})")
    if ctes:
        parts.append(ctes)
    head = f"WITH {', '.join(parts)} " if parts else ""
    if names:
        swap = ", ".join(f'round("{c}" + "{c}" * CAST(1e-12 AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS "{c}"' for c in names)
        return f"{head}SELECT * REPLACE ({swap}) FROM ({body}) q"
    return head + body


def query(name: str, oracle: str | None = None):
    """Register a query; its result is rounded."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: rounded(fn(spark, sf))
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register
