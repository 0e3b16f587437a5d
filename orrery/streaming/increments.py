"""Batch operators over arriving files, each file once.

The reference workflow has no event time; this only runs a batch operator on
what is new. Every batch is written under its own number, so a batch that runs
again after a failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def increments(spark: SparkSession, source: str, schema: T.StructType | str, target: str, checkpoint: str, operator: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000) -> None:
    """Apply `operator` to the parquet files of `source` not yet seen, until none is left."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
