"""Bringing tables into line: sibling gaps, checked and all-or-nothing updates, sync plans, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def sibling_gaps(catalog: DataFrame, subjects: DataFrame, used: DataFrame, subject: str) -> DataFrame:
    """Codes of catalog(code) that no sibling of `subject` uses.

    subjects(subject, prefixes): siblings share a prefix with the subject, which
    is its own sibling; used(subject, code). Siblings are found by an equi-join on prefixes.
    """
    each = subjects.select("subject", F.explode(F.array_distinct("prefixes")).alias("prefix"))
    own = each.filter(F.col("subject") == subject).select("prefix")
    siblings = each.join(own, "prefix", "left_semi").select("subject").distinct()
    seen = used.join(siblings, "subject", "left_semi").select("code").distinct()
    return catalog.join(seen, "code", "left_anti")


def with_reason(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Add reason: the name of the first check that fails (a null condition fails too), null if all hold."""
    out = F.lit(None).cast("string")
    for why, holds in reversed(checks):
        out = F.when(F.coalesce(holds, F.lit(False)), out).otherwise(F.lit(why))
    return rows.withColumn("reason", out)


def flagged(rows: DataFrame, known: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Add flag: whether the keys are in `known`."""
    return rows.join(known.select(*keys).distinct().withColumn(flag, F.lit(True)), keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def all_or_nothing(rows: DataFrame, item: str, conflict: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of items without any conflict, and (item, n_conflicts, n_rows) of those with one: these keep every row back."""
    over = W.partitionBy(item)
    d = rows.withColumn("_c", F.count_if(F.coalesce(conflict, F.lit(False))).over(over))
    held = d.filter("_c > 0").groupBy(item).agg(F.max("_c").alias("n_conflicts"), F.count(F.lit(1)).alias("n_rows"))
    return d.filter("_c = 0").drop("_c"), held


def sync_plan(source: DataFrame, target: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """keys, action: copy what is new or differs in `stamp`, delete what the source lacks, keep the rest."""
    s, t = source.select(*keys, F.col(stamp).alias("_s"), F.lit(True).alias("_in_s")), target.select(*keys, F.col(stamp).alias("_t"), F.lit(True).alias("_in_t"))
    action = F.when(F.col("_in_s").isNull(), "delete").when(F.col("_in_t").isNotNull() & F.col("_s").eqNullSafe(F.col("_t")), "keep").otherwise("copy")
    return s.join(t, keys, "full_outer").select(*keys, action.alias("action"))


def by_priority(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def set_differences(rows: DataFrame, declared: str, actual: str) -> DataFrame:
    """Add missing and surplus, sorted, and same: whether the two lists hold the same values."""
    d = rows.withColumns({"missing": F.array_sort(F.array_except(declared, actual)), "surplus": F.array_sort(F.array_except(actual, declared))})
    return d.withColumn("same", (F.size("missing") == 0) & (F.size("surplus") == 0))


def completeness(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, total, missing."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(value).isNull()).alias("missing"))
