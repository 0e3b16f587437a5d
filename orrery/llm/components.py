"""Connected components of a link table, by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of a link: one root per component.

    Each round every node moves to the neighbour (or itself) of the smallest
    seeded hash; links move along, doubles and loops go. A constant share of
    the nodes goes each round, whatever the shape; hot nodes are reduced by
    min() before the shuffle. Rounds are cut, so a lost executor costs one.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    roots, turn = None, 0
    while not e.isEmpty():
        h = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c).alias("h"), c.alias("n"))
        move = both(e).groupBy("a").agg(F.least(h(F.col("a")), F.min(h(F.col("b"))))["n"].alias("to"))
        move = cut(move.withColumnRenamed("a", "node"))
        if roots is None:
            roots = move.select("node", F.col("to").alias("root"))
        else:
            m = move.select(F.col("node").alias("root"), "to")
            roots = cut(roots.join(m, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        x, y = move.select(F.col("node").alias("a"), F.col("to").alias("ta")), move.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        e = e.join(x, "a").join(y, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).filter("a <> b")
        e = cut(e.distinct())
        turn += 1
    if roots is None:
        roots = edges.select(F.col(a).alias("node"), F.col(a).alias("root")).limit(0)
    return roots
