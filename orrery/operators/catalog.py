"""Catalogs: membership with a stated basis, longest prefix, rules, gaps, trees, sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def code_owners(catalog: DataFrame, code: str = "code", revision: str = "revision") -> DataFrame:
    """code, owners: which revisions hold a code."""
    return catalog.groupBy(code).agg(F.array_sort(F.collect_set(revision)).alias("owners"))


def in_scope(rows: DataFrame, catalog: DataFrame, prefixes: list[str], code: str = "code") -> DataFrame:
    """Add basis: catalog membership first, a prefix only as flagged fallback, else none."""
    known = catalog.select(F.col(code)).distinct().withColumn("_known", F.lit(True))
    by_prefix = F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(F.col(code), p)) if prefixes else F.lit(False)
    basis = F.when(F.col("_known"), "catalog").when(by_prefix, "prefix").otherwise("none")
    return rows.join(known, code, "left").withColumn("basis", basis).drop("_known")


def longest_prefix(codes: DataFrame, prefixes: DataFrame, code: str = "code", prefix: str = "prefix", owner: str = "owner") -> DataFrame:
    """code, prefix, owner, n_owners: the longest prefix that starts a code; the first owner, ties counted.

    A code lists its own prefixes, so the match is an equi-join at any size.
    """
    own = codes.select(code).distinct().withColumn("_p", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(code), F.lit(1))), lambda i: F.substring(F.col(code), F.lit(1), i))))
    p = prefixes.groupBy(F.col(prefix).alias("_p")).agg(F.min(owner).alias("_o"), F.countDistinct(owner).alias("_n"))
    best = own.join(p, "_p").groupBy(code).agg(F.max(F.struct(F.length("_p").alias("l"), "_p", "_o", "_n")).alias("b"))
    return codes.select(code).distinct().join(best, code, "left").select(code, F.col("b._p").alias(prefix), F.col("b._o").alias(owner), F.coalesce("b._n", F.lit(0)).alias("n_owners"))


def first_rule(rows: DataFrame, rules: list[tuple[str, dict]], subject: str) -> DataFrame:
    """Add rule (1 is first; null for none): the first pattern found anywhere in the subject.

    Rules are configuration: they become one CASE, not a join.
    """
    out = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        out = F.when(F.col(subject).rlike(rules[i - 1][0]), F.lit(i)).otherwise(out)
    return rows.withColumn("rule", out)


def rule_coverage(rows: DataFrame, rules: list[tuple[str, dict]], subject: str) -> DataFrame:
    """rule, pattern, matches: how many rows each pattern finds, first or not; 0 shows a dead rule."""
    counts = rows.agg(*[F.count_if(F.col(subject).rlike(p)).alias(f"r{i}") for i, (p, _) in enumerate(rules)])
    each = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("rule"), F.lit(p).alias("pattern"), F.col(f"r{i}").alias("matches")) for i, (p, _) in enumerate(rules)]))
    return counts.select(each.alias("x")).select("x.*")


def gaps(catalog: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Catalog rows that nothing uses."""
    return catalog.join(used.select(*keys).distinct(), keys, "left_anti")


def tree(rows: DataFrame, outer: str, inner: str, leaf: str) -> DataFrame:
    """outer, nodes: [(inner, leaves)], each level in order."""
    low = rows.groupBy(outer, inner).agg(F.sort_array(F.collect_list(leaf)).alias("leaves"))
    return low.groupBy(outer).agg(F.sort_array(F.collect_list(F.struct(inner, "leaves"))).alias("nodes"))


def sheet(rows: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A row per `row`, a column per value of `column`; columns are named, so no extra pass finds them."""
    return rows.groupBy(row).pivot(column, columns).agg(F.sum(value)).na.fill(0, columns)
