"""Every registered query runs, and equals its SQL twin where there is one."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, canonical  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are absent")
# Refit-based stress tests take minutes; tests/test_properties.py covers them on small frames.
SLOW = {"n3_ablation", "n5_cv"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for sign in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert sign not in plan
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        assert got[1]
        return
    cur = con.execute(ORACLE[name])
    assert got == canonical([d[0] for d in cur.description], cur.fetchall())


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 2
