"""Helpers shared by the operators: written cuts, prefix sums, Arrow mapping."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from orrery.functions.arrow import small_batches

_own_dirs: dict[str, str] = {}
_tracked: list[list[str]] = []

#: A word is a maximal run without these six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests) a folder
    of our own is made and used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_dirs:
        _own_dirs[key] = tempfile.mkdtemp(prefix="orrery-")
    return "file://" + _own_dirs[key]


@contextmanager
def tracked() -> Iterator[list[str]]:
    """A list of the tables that `cut` writes meanwhile."""
    made: list[str] = []
    _tracked.append(made)
    try:
        yield made
    finally:
        _tracked.remove(made)


def remove(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete tables that nothing reads any more; shuffles of dropped plans go with them."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if paths:
        spark._jvm.System.gc()


def cut(df: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage: what comes after survives the loss of executors
    without recomputing what came before, and is computed once however often
    it is read.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    for made in _tracked:
        made.append(path)
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exclusive_offsets(df: DataFrame, part: Sequence[str], idx: str, n: str, out: str, block: int = 256) -> DataFrame:
    """Add `out`: the sum of `n` over the rows of the same part with smaller idx.

    One row per (part, idx) is expected; part columns hold no nulls. The sum
    runs over two levels, so no window holds more than `block` rows of the
    finer one: a part with any number of rows is spread over many tasks.
    """
    inner = W.partitionBy(*part, "_blk").orderBy(idx).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*part).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    a = df.withColumn("_blk", F.floor(F.col(idx) / block))
    t = a.groupBy(*part, "_blk").agg(F.sum(n).alias("_tot")).withColumn("_base", F.coalesce(F.sum("_tot").over(outer), F.lit(0))).drop("_tot")
    a = a.withColumn("_in", F.coalesce(F.sum(n).over(inner), F.lit(0)))
    return a.join(t, [*part, "_blk"]).withColumn(out, (F.col("_base") + F.col("_in")).cast("long")).drop("_blk", "_base", "_in")


def free(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def running(df: DataFrame, order: Sequence[Column], value: Column, out: str, block: int = 4_096) -> DataFrame:
    """Add `out`: the sum of `value` over all rows before this one in the order of all rows.

    Rows are range-sorted and written; sums run within blocks of consecutive
    rows and over the blocks, so no task holds them all.
    """
    s = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    s = s.withColumns({"_v": value, "_blk": F.floor(F.col("_m") / block)})
    t = s.groupBy("_blk").agg(F.sum("_v").alias("_tot")).withColumn("_base", F.coalesce(F.sum("_tot").over(W.orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_tot")
    s = s.withColumn("_in", F.coalesce(F.sum("_v").over(W.partitionBy("_blk").orderBy("_m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return s.join(t, "_blk").withColumn(out, F.col("_base") + F.col("_in")).drop("_m", "_v", "_blk", "_in", "_base")


def give_back() -> None:
    """Return memory that this worker has freed to the system, where its C library can.

    Workers live on from task to task and stage to stage, and what one task has
    freed else stays with the worker, beside the executor's own memory.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def thrifty(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's generator that gives its memory back when it ends."""

    def to_the_end(it: Iterator) -> Iterator:
        try:
            yield from run(it)
        finally:
            give_back()

    return to_the_end


def arrow_map(df: DataFrame, fn: Callable[[list[list]], dict[str, list]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with Python lists: fn gets a list per input column and returns a list per output column."""
    small_batches(df.sparkSession)
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    target = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict(fn([c.to_pylist() for c in b.columns]), schema=target)

    return df.mapInArrow(thrifty(run), struct)


def text_of(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(df[text], F.lit(""))


def words(text: Column) -> Column:
    """The words of a text as an array; null counts as empty."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " +"), "")
