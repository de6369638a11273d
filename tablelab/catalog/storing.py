"""Queries that write to a new folder beside the session's checkpoints and read the result back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import labeling as lab
from ..session import ensure_checkpoint_dir
from ..sources import io
from .base import query, sql, table, view
from .deriving import LABEL_CTE, NAMES, labelled
from .profiling import _union

V, D, L = "dirty_part", "label_docs", "line_features"


def folder(s) -> str:
    return f"{ensure_checkpoint_dir(s).rstrip('/')}/stored-{uuid.uuid4().hex}"


CSV_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("size", T.DoubleType())])


def _csv(s, d):
    """Every 10th line has a field too many, every 7th one too few, every 13th a word for a number."""
    i = F.col("id")
    size = F.when(i % 13 == 0, F.lit("big")).otherwise(F.col("size").cast("int").cast("string"))
    line = (
        F.when(i % 10 == 0, F.concat_ws(",", i.cast("string"), "kind", F.lit("9"), F.lit("surplus")))
        .when(i % 7 == 0, F.concat_ws(",", i.cast("string"), "kind"))
        .otherwise(F.concat_ws(",", i.cast("string"), "kind", size))
    )
    path = folder(s)
    view(s, d, V).filter("size IS NOT NULL").select(line.alias("value")).write.text(path)
    return io.read_csv_tolerant(s, path, CSV_SCHEMA, header=False)


@query(
    "s1_tolerant_csv",
    sql(f"SELECT id, kind, CASE WHEN id % 7 <> 0 AND id % 13 <> 0 THEN size END AS size FROM {V} WHERE size IS NOT NULL AND id % 10 <> 0", V, doubles="size"),
)
def _(s, d):
    return _csv(s, d)[0]


@query("s1_bad_rows", sql(f"SELECT count(*) AS n FROM {V} WHERE size IS NOT NULL AND id % 10 = 0", V))
def _(s, d):
    return _csv(s, d)[1].agg(F.count("*").alias("n"))


# Keys beyond 2**53, which a double does not tell apart, and amounts of more digits than it has.
_KEY = "9007199254740993 + 2 * l_orderkey + l_linenumber"
_AMOUNT = "CAST(90071992547409 AS DECIMAL(18,4)) + CAST(l_linenumber AS DECIMAL(9,0)) * CAST(0.125 AS DECIMAL(4,3))"


@query(
    "s1_exact_numbers",
    sql(f"SELECT k AS key, count(*) AS n, sum(CAST(a AS DECIMAL(20,4)))::VARCHAR AS amount FROM (SELECT {_KEY} AS k, CAST({_AMOUNT} AS DECIMAL(20,4)) AS a FROM lineitem) GROUP BY k"),
)
def _(s, d):
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("amount", T.DecimalType(20, 4))])
    path = folder(s)
    table(s, d, "lineitem").select(F.concat_ws(",", F.expr(_KEY).cast("string"), F.expr(f"CAST({_AMOUNT} AS DECIMAL(20,4))").cast("string")).alias("value")).write.text(path)
    rows, _ = io.read_csv_tolerant(s, path, schema, header=False)
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(38,4)").cast("string").alias("amount"))


@query("s3_table", sql(f"SELECT * FROM {V}", V, doubles="price size const price2"))
def _(s, d):
    path = folder(s)
    io.write_table(view(s, d, V), path)
    return io.read_table(s, path)


@query(
    "s4_label_subsets",
    sql(
        _union(f"SELECT '{n}' AS subset, id, tech, fill FROM labelled WHERE {n} = 1" for n in ("tech", "fill", "none"))
        + " UNION ALL SELECT 'multi_label', id, tech, fill FROM labelled WHERE tech + fill + none > 1",
        D, ctes=LABEL_CTE,
    ),
)
def _(s, d):
    path = folder(s)
    io.write_label_subsets(labelled(s, d).select("id", *NAMES), NAMES, path)
    return io.read_table(s, path).select("subset", "id", "tech", "fill")


@query("s5_multi_label", sql("SELECT id FROM labelled WHERE tech + fill + none > 1", D, ctes=LABEL_CTE))
def _(s, d):
    path = folder(s)
    io.write_label_subsets(labelled(s, d).select("id", *NAMES), NAMES, path)
    return s.read.parquet(path).filter("subset = 'multi_label'").select("id")


@query(
    "s6_report",
    sql(_union(f"SELECT '{n}' AS label, sum({n})::BIGINT AS n, round(100 * avg({n}), 2) AS percent FROM labelled" for n in NAMES), D, ctes=LABEL_CTE, doubles="percent"),
)
def _(s, d):
    path = folder(s)
    io.write_report({"labels": lab.label_counts(labelled(s, d), NAMES)}, path)
    return s.read.json(f"{path}/labels")
