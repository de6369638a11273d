"""Missing-value rules shared by every operator.

One marker only: null. NaN is turned into null on entry, because Spark sorts NaN
above every number and treats it as equal to itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: text forms that count as a number when text is coerced.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Fixed value: the missing-value texts recognised by default.
MISSING_TEXTS = ("", "NA", "N/A", "NaN", "nan", "null", "None", ".", "-", "?")


def as_column(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in every floating column."""
    changed = {
        f.name: F.when(~F.isnan(as_column(f.name)), as_column(f.name))
        for f in df.schema.fields
        if is_floating(f.dataType)
    }
    return df.withColumns(changed) if changed else df


def to_number(c: Column | str) -> Column:
    """Text to double; whatever does not look like a number becomes null (never raises under ANSI)."""
    col = as_column(c)
    text = col.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def coerce(df: DataFrame, name: str) -> Column:
    """Numeric coercion of one column of ``df``: a cast for numbers, ``to_number`` for text."""
    dtype = df.schema[name].dataType
    if is_numeric(dtype):
        value = as_column(name).cast("double")
        return F.when(~F.isnan(value), value) if is_floating(dtype) else value
    return to_number(name)


def exact_number(df: DataFrame, name: str) -> Column:
    """As ``coerce``, but whole and decimal numbers keep their type, which double can't hold beyond 2**53."""
    dtype = df.schema[name].dataType
    return as_column(name) if is_numeric(dtype) and not is_floating(dtype) else coerce(df, name)


def whole_number(df: DataFrame, name: str) -> Column:
    """Long; digits are read as they stand, other text and floats through double."""
    dtype = df.schema[name].dataType
    if is_numeric(dtype) and not is_floating(dtype):
        return as_column(name).try_cast("long")
    rounded = coerce(df, name).try_cast("long")
    if is_numeric(dtype):
        return rounded
    text = as_column(name).cast("string")
    return F.coalesce(F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("long")), rounded)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def flag(c: Column) -> Column:
    """Predicate to 0/1, null counting as 0."""
    return F.coalesce(c.cast("int"), F.lit(0))


# Fixed value: the characters that count as white space when text is stripped.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column | str) -> Column:
    """Trim every kind of Unicode white space on both ends."""
    return F.btrim(as_column(c), F.lit(WHITE_SPACE))
