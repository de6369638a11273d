"""Row-wise operators over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import words


#: Rows of one Arrow batch: texts are long rows, and a task holds a batch several times on its way to Python.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """The table, after lowering the session's Arrow batches to ``BATCH_ROWS`` rows where they are larger."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_KEY)) <= BATCH_ROWS:
        conf.set(_BATCH_KEY, str(BATCH_ROWS))
    return df


def add_columns(df: DataFrame, text: str, keep: Sequence[str], fields: Sequence[tuple[str, T.DataType]], make: Callable[[], Callable], also: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns of every row and the ``fields`` that are made from its text.

    ``make`` runs once per task and returns a function from a text column (an Arrow array of about
    ``words.STEP_BYTES``) and the columns in ``also`` to one list or array per field. Other columns of the input
    are not read.
    """
    selected = df.select(*dict.fromkeys([*keep, text, *also]))
    schema = T.StructType([selected.schema[k] for k in keep] + [T.StructField(n, t) for n, t in fields])
    kinds = [to_arrow_type(t) for _, t in fields]
    names = [*keep, *(n for n, _ in fields)]
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            column = batch.column(text)
            for start, end in words.steps(column):
                made = function(column.slice(start, end - start), *(batch.column(c).slice(start, end - start) for c in also))
                arrays = [batch.column(k).slice(start, end - start) for k in keep]
                arrays += [m if isinstance(m, pa.Array) else pa.array(m, kind) for m, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return small_batches(selected).mapInArrow(run, schema)


def give_back() -> None:
    """Hand memory that a task has freed to the system, as its worker waits for the next task beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library than glibc
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table that several jobs read, written to the session's shared folder."""
    from ..session import checkpointed

    return checkpointed(df)
