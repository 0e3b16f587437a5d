"""Reads that set broken rows apart, and layered reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def json_rows(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good rows, with the file they came from, and attention rows for broken ones with what could be read."""
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    asked = T.StructType([*struct.fields, T.StructField("_broken", T.StringType())])
    paths = [path] if isinstance(path, str) else list(path)
    d = spark.read.schema(asked).json(paths, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken").withColumn("file", F.col("_metadata.file_path"))
    bad = d.filter("_broken IS NOT NULL").select(F.col("file").alias("id"), F.lit("not readable as JSON").alias("why"), F.lit("warn").alias("severity"), F.to_json(F.struct(*struct.fieldNames())).alias("read"))
    return d.filter("_broken IS NULL").drop("_broken"), bad


def overlay(layers: Sequence[DataFrame], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the first layer that holds each key, and attention rows where a later one holds it too."""
    ranked = [d.withColumn("_layer", F.lit(i)) for i, d in enumerate(layers)]
    both = ranked[0]
    for d in ranked[1:]:
        both = both.unionByName(d, allowMissingColumns=True)
    first = F.min("_layer").over(W.partitionBy(*keys))
    both = both.withColumn("_first", first)
    shadowed = both.filter("_layer > _first").select(F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("id"), F.lit("shadowed by an earlier layer").alias("why"), F.lit("warn").alias("severity")).distinct()
    return both.filter("_layer = _first").drop("_layer", "_first"), shadowed
