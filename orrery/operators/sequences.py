"""Operators on ordered rows: fills, sections, blocks, runs, repeated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def filled(rows: DataFrame, group: list[str], order: str, value: str, out: str) -> DataFrame:
    """Last value seen so far; the head takes the first value that follows."""
    w = W.partitionBy(*group).orderBy(order)
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return rows.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), ahead))


def sections(rows: DataFrame, group: list[str], order: str, starts: Column, end: str) -> DataFrame:
    """Rows that start a section, each with the order value where the next begins (null for the last)."""
    return rows.filter(starts).withColumn(end, F.lead(order).over(W.partitionBy(*group).orderBy(order)))


def groups(rows: DataFrame, group: list[str], order: str, starts: Column, out: str) -> DataFrame:
    """Number the runs that begin at starting rows; rows before the first get 0."""
    return rows.withColumn(out, F.sum(starts.cast("int")).over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def expected_sequence(numbers: Column) -> Column:
    """How many of an array's numbers are accepted by a scan that takes only the next expected one, from 1."""
    return F.aggregate(numbers, F.lit(0), lambda n, x: F.when(x == n + 1, n + 1).otherwise(n))


def outliers(rows: DataFrame, group: str, value: str, share: float = 0.75, least: int = 3) -> DataFrame:
    """Rows under a share of their group's largest value, in groups of at least `least`; groups are joined, not windowed."""
    g = rows.groupBy(group).agg(F.max(value).alias("_max"), F.count(F.lit(1)).alias("_n"))
    return rows.join(g, group).filter((F.col("_n") >= least) & (F.col(value) < share * F.col("_max"))).drop("_max", "_n")


def repeated_lines(lines: DataFrame, group: str, page: str, text: str, least: int = 5, share: float = 0.25) -> DataFrame:
    """group, text, pages: lines on at least max(least, share of the group's pages) distinct pages."""
    n = lines.groupBy(group).agg(F.countDistinct(page).alias("_n"))
    r = lines.groupBy(group, text).agg(F.countDistinct(page).alias("pages"))
    return r.filter(F.col("pages") >= least).join(n, group).filter(F.col("pages") >= F.greatest(F.lit(float(least)), share * F.col("_n"))).select(group, text, "pages")
