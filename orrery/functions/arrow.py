"""Arrow batches bounded by bytes, for functions and operators with Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Arrow batches hold so many bytes at most (or one row).
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold BATCH_BYTES at most, if the session allows more.

    The session's bound on rows alone lets a batch grow with the texts. It stays
    lowered, since plans are run after the operator has returned.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(bound))
    if size > BATCH_BYTES:
        spark.conf.set(bound, str(BATCH_BYTES))
