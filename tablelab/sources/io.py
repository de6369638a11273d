"""Reading and writing: tolerant CSV, Parquet, label subsets, reports."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.groups import by_label
from ..functions.nulls import NUMBER_PATTERN, as_column, is_numeric, nan_to_null, to_number, whole_number
from ..operators.labeling import set_count

CORRUPT = "_corrupt_record"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet (by its columns) or CSV with a header; NaN becomes null."""
    if path.rstrip("/").endswith((".csv", ".csv.gz", ".tsv")):
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return nan_to_null(reader.csv(path))
    return nan_to_null(spark.read.parquet(path))


def read_csv_tolerant(spark: SparkSession, path: str, schema: T.StructType, **options) -> tuple[DataFrame, DataFrame]:
    """(rows, bad rows). A row with too many fields is bad and skipped; a short one is filled with nulls.

    Values that do not fit their type become null and keep the row, so number columns are read as text
    and coerced afterwards.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(CORRUPT, T.StringType())])
    raw = (
        spark.read.schema(text)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        # A pruned parser does not see surplus fields, so every field is parsed.
        .option("columnPruning", False)
        .options(**options)
        .csv(path)
    )
    # Spark marks short rows too, so the fields of a marked row are counted: separators outside quotes, and one.
    # Spark reads the marked line only together with a column of the file.
    some = F.coalesce(F.length(F.col(f"`{schema.fields[-1].name}`")), F.lit(0)) >= 0
    too_long = F.col(CORRUPT).isNotNull() & some & (_fields(F.col(CORRUPT), options) > len(schema.fields))

    typed = [_typed(raw, f).alias(f.name) for f in schema.fields]
    return raw.filter(~too_long).select(*typed), raw.filter(too_long).select(CORRUPT)


def _typed(raw: DataFrame, field: T.StructField) -> Column:
    """The text of a field in its type, null where it does not fit. Whole and decimal numbers don't pass through double."""
    text = as_column(field.name)
    if isinstance(field.dataType, T.IntegralType):
        return whole_number(raw, field.name).try_cast(field.dataType)
    if isinstance(field.dataType, T.DecimalType):
        return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast(field.dataType))
    return (to_number(text) if is_numeric(field.dataType) else text).try_cast(field.dataType)


def _fields(line: Column, options: Mapping[str, str]) -> Column:
    """Number of fields of a CSV line."""
    quote, escape, separator = (options.get(k, v) for k, v in (("quote", '"'), ("escape", "\\"), ("sep", options.get("delimiter", ","))))
    q, e = re.escape(quote), re.escape(escape)
    bare = F.regexp_replace(line, f"{q}(?:[^{q}{e}]|{e}.|{q}{q})*{q}", "") if quote else line
    return F.size(F.split(bare, re.escape(separator), -1))


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet, or CSV with a header for a path ending in .csv."""
    if path.rstrip("/").endswith(".csv"):
        df.write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).parquet(path)


def write_label_subsets(df: DataFrame, labels: Sequence[str], path: str, mode: str = "error", multi: bool = True) -> None:
    """One partition per label with members, in one job and without a shuffle; empty labels write nothing.

    ``multi`` adds the partition ``multi_label`` with the rows of more than one label.
    """
    members = by_label(df, labels, name="subset")
    if multi and len(labels) > 1:
        several = df.filter(set_count(labels) > 1).withColumn("subset", F.lit("multi_label"))
        members = members.unionByName(several)
    members.write.mode(mode).partitionBy("subset").parquet(path)


def write_report(reports: Mapping[str, DataFrame], path: str, mode: str = "error") -> None:
    """Each report table as JSON lines under its name."""
    for name, table in reports.items():
        table.write.mode(mode).json(f"{path.rstrip('/')}/{name}")
