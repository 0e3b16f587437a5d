"""Attention rows: severity order, caps with overflow counts, checks to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Severities, gravest first.
SEVERITIES = ("error", "warn", "info")


def severity_rank(c: Column) -> Column:
    out = F.lit(len(SEVERITIES))
    for i in range(len(SEVERITIES) - 1, -1, -1):
        out = F.when(c == SEVERITIES[i], F.lit(i)).otherwise(out)
    return out


def capped(rows: DataFrame, cap: int = 30, seq: str = "seq", severity: str = "severity", by: list[str] | None = None) -> DataFrame:
    """The first `cap` rows by (severity, seq), per group if any, with `truncated`: how many were left out."""
    groups = by or []
    if groups:
        w = W.partitionBy(*groups)
        r = rows.withColumn("_rank", F.row_number().over(w.orderBy(severity_rank(F.col(severity)), seq)))
        counts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
        return r.filter(F.col("_rank") <= cap).join(counts, groups).withColumn("truncated", F.greatest(F.col("_n") - cap, F.lit(0))).drop("_rank", "_n")
    top = rows.orderBy(severity_rank(F.col(severity)), seq).limit(cap)  # a heap per task, merged
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    return top.crossJoin(F.broadcast(n)).withColumn("truncated", F.greatest(F.col("_n") - cap, F.lit(0))).drop("_n")


def top_above(rows: DataFrame, value: str, least: float, limit: int, key: str) -> DataFrame:
    """Rows at or above `least`, highest first, at most `limit`, with `overflow`."""
    r = rows.filter(F.col(value) >= least)
    n = r.agg(F.count(F.lit(1)).alias("_n"))
    return r.orderBy(F.col(value).desc(), key).limit(limit).crossJoin(F.broadcast(n)).withColumn("overflow", F.greatest(F.col("_n") - limit, F.lit(0))).drop("_n")


def or_omitted(rows: DataFrame, limit: int, columns: list[str]) -> DataFrame:
    """The rows, or one `_omitted` row with the count where there are more than `limit`."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    few = rows.select(*columns).crossJoin(F.broadcast(n)).filter(F.col("_n") <= limit).drop("_n")
    many = n.filter(F.col("_n") > limit).select(F.lit("_omitted").alias(columns[0]), *[F.col("_n").cast("string").alias(c) for c in columns[1:]])
    return few.unionByName(many)


def checks(rows: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """key, why, severity for each (why, severity, condition) that holds; one pass, one row per finding."""
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(w).alias("why"), F.lit(s).alias("severity"))) for w, s, c in rules]))
    return rows.select(key, F.explode(found).alias("x")).select(key, "x.why", "x.severity")


def invariants(rows: DataFrame, group: str, value: str, expected: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """group, n, total, n_ok, total_ok against expected(group, want_n, want_total); null wants are not checked."""
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    j = expected.join(g, group, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.withColumns({"n_ok": F.col("n") == F.col("want_n"), "total_ok": F.abs(F.col("total") - F.col("want_total")) <= tolerance})
