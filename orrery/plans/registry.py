"""Queries of the library by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes, as Spark estimates the columns read, that one task of `dealt` gets.
DEALT_BYTES = 4 << 20


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Narrow rows of a table, dealt by columns or in turn, over as many tasks as a shuffle has.

    Three a core at least: what is done to each row of a small file is else done
    in one task, however many cores there are. One for every DEALT_BYTES
    as well, so that a task's share stays as the table grows.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism, -(-size // DEALT_BYTES))
    return df.repartition(n, *by)


def _load() -> None:
    from orrery.plans import analytics, corpus, items, papers, relational, sheets  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
