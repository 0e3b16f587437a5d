"""Vocabulary learning from labelled rows by log-odds, with gates in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orrery.functions.text import has_tokens, round4, terms

ALPHA, LEAST_DF, COMMON, LEAST_LOR, CAP = 0.5, 2, 0.4, 1.0, 15
#: Best terms of a class that are folded at once.
FIRST = 2_000
#: Characters of a term up to which its substrings are listed.
LONG = 64


def contingency(docs: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """code, term, a (in class), df (overall), n_c, n: over labelled documents that have terms."""
    d = docs.select(F.col(label).alias("code"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t")).filter("code IS NOT NULL")
    per = d.filter(has_tokens(F.col("_t"))).groupBy("code").agg(F.count(F.lit(1)).alias("n_c"))
    n = F.sum("n_c").over(W.partitionBy())  # a row per class
    a = d.select("code", F.explode(terms(F.col("_t"))).alias("term")).groupBy("code", "term").agg(F.count(F.lit(1)).alias("a"))
    a = a.withColumn("df", F.sum("a").over(W.partitionBy("term")))  # a row per class and term
    return a.join(F.broadcast(per.withColumn("n", n)), "code")


def log_odds(c: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Add lor and weight = sigmoid(lor) * a / (a + 2)."""
    b = F.col("df") - F.col("a")
    lor = F.log((F.col("a") + alpha) / (F.col("n_c") - F.col("a") + alpha)) - F.log((b + alpha) / (F.col("n") - F.col("n_c") - b + alpha))
    c = c.withColumn("lor", lor)
    return c.withColumn("weight", round4(1 / (1 + F.exp(-F.col("lor"))) * F.col("a") / (F.col("a") + 2)))


def rounded(c: DataFrame) -> DataFrame:
    """lor as it is shown, to three places; gates and weights take the whole value."""
    return c.withColumn("lor", F.floor(F.col("lor") * 1000 + 0.5) / 1000)


def gated(c: DataFrame) -> DataFrame:
    """Add gate: the first that a term fails (rare, common, low_lor), or passed."""
    gate = F.when(F.col("a") < LEAST_DF, "rare").when(F.col("df") > COMMON * F.col("n"), "common").when(F.col("lor") < LEAST_LOR, "low_lor").otherwise("passed")
    return c.withColumn("gate", gate)


def learned(g: DataFrame, cap: int = CAP, first: int = FIRST) -> DataFrame:
    """Passed terms by (weight desc, df desc, term), those inside a better kept one of the class absorbed, at most `cap` a class.

    A class's `first` best terms nearly always hold `cap` that stay: they are
    folded in order. A class that they do not fill is settled over all of its
    terms instead.
    """
    by = W.partitionBy("code").orderBy(F.col("weight").desc(), F.col("df").desc(), "term")
    p = g.filter("gate = 'passed'").select("code", "term", "a", "df", "lor", "weight")
    best = p.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= first)
    rec = F.struct("_r", "term", "a", "df", "lor", "weight")
    lists = best.groupBy("code").agg(F.array_sort(F.collect_list(rec)).alias("_rows"))
    none = F.slice("_rows", 1, 0)
    take = lambda acc, x: F.when((F.size(acc) >= cap) | F.exists(acc, lambda k: F.contains(k["term"], x["term"])), acc).otherwise(F.concat(acc, F.array(x)))
    folded = lists.withColumns({"_kept": F.aggregate("_rows", none, take), "_n": F.size("_rows")})
    enough = (F.size("_kept") >= cap) | (F.col("_n") < first)
    quick = folded.filter(enough).select("code", F.posexplode("_kept").alias("_i", "k"))
    quick = quick.select("code", "k.term", "k.a", "k.df", "k.lor", "k.weight", (F.col("_i") + 1).cast("int").alias("rank"))
    open_ = folded.filter(~enough).select("code")
    return quick.unionByName(learned_of_many(p.join(open_, "code", "left_semi"), cap))


def learned_of_many(p: DataFrame, cap: int = CAP) -> DataFrame:
    """`learned` for classes of any number of passed terms.

    Better terms meet a term by equality on their own substrings, so no class
    is compared pair by pair; only terms longer than LONG, whose substrings
    are too many, are held against their class. A term inside an absorbed one
    lies inside a kept one that is better still, so they need not be told apart.
    """
    by = W.partitionBy("code").orderBy(F.col("weight").desc(), F.col("df").desc(), "term")
    p = p.withColumn("_r", F.row_number().over(by))
    n = F.length("term")
    lengths = lambda a: F.sequence(F.lit(1), n - a + 1)
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda a: F.transform(lengths(a), lambda k: F.substr(F.col("term"), a, k))))
    inside = p.filter(n <= LONG).select("code", "_r", F.explode(parts).alias("term")).groupBy("code", "term").agg(F.min("_r").alias("_br"))
    inside = p.join(inside, ["code", "term"]).filter("_br < _r").select("code", "term")
    long = p.filter(n > LONG).select("code", F.col("term").alias("_in"), F.col("_r").alias("_br"))
    inside = inside.union(p.join(long, "code").filter((F.col("_br") < F.col("_r")) & F.contains("_in", "term")).select("code", "term"))
    kept = p.join(inside, ["code", "term"], "left_anti")
    return kept.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= cap).select("code", "term", "a", "df", "lor", "weight", "rank")


def funnel(g: DataFrame) -> DataFrame:
    return g.groupBy("code").agg(F.count(F.lit(1)).alias("candidates"), *[F.count_if(F.col("gate") == x).alias(x) for x in ("rare", "common", "low_lor", "passed")])
