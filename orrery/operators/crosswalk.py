"""Cross-walk application with protected manual values, and gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply(items: DataFrame, mapping: DataFrame, key: str, fields: list[str], by: str = "by", protected: tuple[str, ...] = ("manual",)) -> DataFrame:
    """key, outcome: applied, unchanged, conflict (a protected value differs in any field: the whole item stays) or missing."""
    i = items.select(F.col(key), F.col(by).alias("_by"), F.lit(True).alias("_is"), *[F.col(f).alias(f"_i_{f}") for f in fields])
    j = mapping.select(key, *fields).join(i, key, "left")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"_i_{f}"))
    outcome = F.when(F.col("_is").isNull(), "missing").when(~differs, "unchanged").when(F.coalesce(F.col("_by").isin(*protected), F.lit(False)), "conflict").otherwise("applied")
    return j.withColumn("outcome", outcome).select(key, "outcome", *fields)


def writable(rows: DataFrame, by: str = "by", force: bool = False) -> DataFrame:
    """Rows that a machine may overwrite: never manual or llm, others if unset or forced."""
    held = F.coalesce(F.col(by).isin("manual", "llm"), F.lit(False))
    return rows.filter(~held & (F.col(by).isNull() | F.lit(force)))


def gold(items: DataFrame, mapping: DataFrame, key: str, label: str) -> DataFrame:
    """key, label, origin: labels of both, the items' own first."""
    a = items.filter(F.col(label).isNotNull()).select(key, F.col(label).alias("_a"))
    b = mapping.filter(F.col(label).isNotNull()).select(key, F.col(label).alias("_b"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("_a", "_b").alias(label), F.when(F.col("_a").isNotNull(), "items").otherwise("mapping").alias("origin"))


def without(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among those done: hold-outs, queues."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def preserve_merge(old: DataFrame, new: DataFrame, key: str, owned: list[str], kept: list[str]) -> DataFrame:
    """One row per key of either: `owned` columns from the new side where it has the key, `kept` ones from the old."""
    o = old.select(key, F.lit(True).alias("_o"), *[F.col(c).alias(f"_o_{c}") for c in (*owned, *kept)])
    n = new.select(key, F.lit(True).alias("_n"), *[F.col(c).alias(f"_n_{c}") for c in owned])
    j = o.join(n, key, "full_outer")
    return j.select(key, *[F.when(F.col("_n"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in owned], *[F.col(f"_o_{c}").alias(c) for c in kept])
