"""Votes over several sources' readings of the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tally(readings: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, votes: (n, value) for each value, most first, ties to the smaller value; nulls do not vote, 0 does."""
    c = readings.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("_n"), F.col(value).alias("value")))).alias("votes"), F.sum("n").alias("voters"))


def _top(i: int) -> Column:
    return F.get("votes", F.lit(i))


def majority(readings: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Unanimous: ok; a strict plurality of two or more: warn; anything else: error and no value."""
    t = tally(readings, keys, value)
    n1, n2 = -_top(0)["_n"], F.coalesce(-_top(1)["_n"], F.lit(0))
    state = F.when(n2 == 0, "ok").when((n1 >= 2) & (n1 > n2), "warn").otherwise("error")
    return t.withColumn("state", state).select(*keys, F.when(F.col("state") != "error", _top(0)["value"]).alias("verdict"), "state", "voters")


def validator(readings: DataFrame, own: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The recorded value votes too; under two voters abstain; unanimous ok, two or more alike warn, else error."""
    t = tally(readings.select(*keys, value).unionByName(own.select(*keys, value)), keys, value)
    n1 = -_top(0)["_n"]
    state = F.when(F.col("voters") < 2, "abstain").when(F.size("votes") == 1, "ok").when(n1 >= 2, "warn").otherwise("error")
    return t.select(*keys, state.alias("state"), "voters")


def gate(pairs: DataFrame, group: str, a: str, b: str, least: int = 5) -> DataFrame:
    """group, checked, mismatches, passed: enough pairs to check and none that differ; nulls are unchecked."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return pairs.groupBy(group).agg(F.count_if(both).alias("checked"), F.count_if(both & (F.col(a) != F.col(b))).alias("mismatches")).withColumn("passed", (F.col("checked") >= least) & (F.col("mismatches") == 0))
