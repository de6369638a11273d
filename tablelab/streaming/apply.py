"""Row-wise operators on a stream: fit on a batch, apply to arriving files.

Cleaning fits, derived columns, labels and subset flags are plain expressions, so the fitted batch
result is applied to a streaming frame without state.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.clean import CleanResult, apply_fitted
from ..plans.label import LabelResult


def read_arriving(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def apply_run(df: DataFrame, cleaned: CleanResult, config: Mapping[str, Any], labelled: LabelResult | None = None) -> DataFrame:
    """Clean arriving rows as the batch was cleaned, then derive, label and flag as the batch plan did."""
    out = apply_fitted(df, cleaned, config)
    return out if labelled is None else labelled.apply(out)


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop; a later start goes on from the checkpoint."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
