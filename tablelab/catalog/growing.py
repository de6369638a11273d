"""Fits read from the states of several batches, beside the SQL of the fit over all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import clean as c
from ..operators import features as fe
from ..operators.state import FitState, keep_state
from ..session import ensure_checkpoint_dir
from .base import ORACLE, query, sql, table, view
from .profiling import NUM

V = "dirty_part"


def _folder(s) -> str:
    return f"{ensure_checkpoint_dir(s).rstrip('/')}/states-{uuid.uuid4().hex}"


def _state(s, d, paired=()) -> FitState:
    """All rows, in three batches that are stored one by one; the second is stored twice, as after a lost executor."""
    df, folder = view(s, d, V), _folder(s)
    for batch in (0, 1, 2, 1):
        FitState.of(df.filter(F.pmod("id", F.lit(3)) == batch), ["price", "size", "const", "quasi", "sparse", "price2"], paired).write(folder, batch)
    return FitState.read(s, folder)


@query("m11_iqr_of_batches", ORACLE["m11_iqr"])
def _(s, d):
    bounds = _state(s, d).outlier_bounds(["price", "size"], "iqr", 0.3)
    return c.null_outliers(view(s, d, V), bounds).select("id", "price", "size")


@query("m12_zscore_of_batches", ORACLE["m12_zscore"])
def _(s, d):
    return c.null_outliers(view(s, d, V), _state(s, d).outlier_bounds(["price"], "zscore", 1.5)).select("id", "price")


@query("c1_corr_of_batches", ORACLE["c1_corr"])
def _(s, d):
    return _state(s, d, NUM).correlations()


@query(
    "d16_edges_of_batches",
    sql(
        f"""SELECT 'size' AS "column", format('{{:.6f}},{{:.6f}},{{:.6f}},{{:.6f}},{{:.6f}}', q[1], q[2], q[3], q[4], q[5]) AS edges
        FROM (SELECT quantile_cont(size, [0, 0.25, 0.5, 0.75, 1]) AS q FROM {V})""",
        V,
    ),
)
def _(s, d):
    edges = _state(s, d).bin_edges("size", 4, "equal_frequency")
    return s.createDataFrame([("size", ",".join(f"{x:.6f}" for x in edges))], "column string, edges string")


@query("d13_standardize_of_batches", sql(f"SELECT id, (size - m) / v AS x FROM {V}, (SELECT avg(size) m, stddev_samp(size) v FROM {V})", V, doubles="x"))
def _(s, d):
    mean, std = _state(s, d).scales(["size"])["size"]
    return view(s, d, V).select("id", fe.z_score(F.col("size"), mean, std).alias("x"))


@query(
    "p3_figures_of_stream",
    sql("""SELECT 'l_quantity' AS "column", count(*) AS n_rows, count(DISTINCT l_quantity) AS n_distinct, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std FROM lineitem
    UNION ALL SELECT 'l_tax', count(*), count(DISTINCT l_tax), avg(l_tax), stddev_samp(l_tax) FROM lineitem""", doubles="mean std"),
)
def _(s, d):
    """Files that arrive one by one leave the state of all of them."""
    folder = _folder(s)
    rows = table(s, d, "lineitem").select("l_quantity", "l_tax")
    rows.repartition(3).write.parquet(f"{folder}/arriving")
    arriving = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arriving")
    keep_state(arriving, f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    figures = FitState.read(s, f"{folder}/state").figures()
    return s.createDataFrame([(k, f["n_rows"], f["n_distinct"], f["mean"], f["std"]) for k, f in figures.items()], "column string, n_rows long, n_distinct long, mean double, std double")
