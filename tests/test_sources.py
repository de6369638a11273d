"""Reading and writing."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.sources import io

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("x", T.DoubleType())])


def test_tolerant_csv(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text('id,name,x\n1,a,1.5\n2,b\n3,c,2.5,extra\n4,"d,e",oops\n,f,3\n')
    rows, bad = io.read_csv_tolerant(spark, str(path), SCHEMA)
    assert [tuple(r) for r in rows.orderBy("name").collect()] == [(1, "a", 1.5), (2, "b", None), (4, "d,e", None), (None, "f", 3.0)]
    assert bad.count() == 1


def test_rows_with_too_many_fields_are_bad_whatever_is_in_them(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text('id,name,x\n1,a,1.5\n2,b,\n3,kind,,surplus\n4,"d,""e",2\n5,a,1,\n6,,,,\n7\n8,"x,y"\n9,b,2,3,4\n')
    rows, bad = io.read_csv_tolerant(spark, str(path), SCHEMA)
    assert [r["id"] for r in rows.orderBy("id").collect()] == [1, 2, 4, 7, 8]
    assert sorted(r[0][:1] for r in bad.collect()) == ["3", "5", "6", "9"]


def test_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, float("nan"))], SCHEMA)
    for name in ("t", "t.csv"):
        io.write_table(df, str(tmp_path / name))
        back = io.read_table(spark, str(tmp_path / name), SCHEMA).orderBy("id").collect()
        assert [tuple(r) for r in back] == [(1, "a", 1.5), (2, None, None)]
    with pytest.raises(Exception):
        io.write_table(df, str(tmp_path / "t"))


def test_label_subsets(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") < 4).cast("int").alias("p"), (F.col("id") > 2).cast("int").alias("q"), F.lit(0).alias("empty"))
    io.write_label_subsets(df, ["p", "q", "empty"], str(tmp_path / "s"))
    got = {r["subset"]: r["count"] for r in spark.read.parquet(str(tmp_path / "s")).groupBy("subset").count().collect()}
    assert got == {"p": 4, "q": 7, "multi_label": 1}


def test_reports(spark, tmp_path):
    io.write_report({"counts": spark.createDataFrame([("a", 1)], "k string, n int")}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "counts")).first().asDict() == {"k": "a", "n": 1}


def test_whole_and_decimal_numbers_keep_their_digits(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("9007199254740993,12345678901234567.89,7\n9.0e3,1e2,99999999999\n3.7,x,\n 8 , 2.5 ,1.0\n")
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("amount", T.DecimalType(20, 2)), T.StructField("small", T.IntegerType())])
    rows, bad = io.read_csv_tolerant(spark, str(path), schema, header=False)
    found = [(r["key"], None if r["amount"] is None else str(r["amount"]), r["small"]) for r in rows.collect()]
    assert found == [(9007199254740993, "12345678901234567.89", 7), (9000, "100.00", None), (3, None, None), (8, "2.50", 1)]
    assert bad.count() == 0
