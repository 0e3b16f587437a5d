"""Quality rules whose thresholds come from mergeable quantile sketches.

Each document gets base measures on its whole text. Their ratios are sketched
per (language, source), per language and overall: a sketch is a histogram on
logarithmic buckets of 2 % relative width, so sketches merge by adding counts,
in any order, with the same result each time. A document fails a rule if its
ratio lies beyond the far fence of its group: upper quartile plus FENCE times
the inter-quartile spread, the spread never taken below a floor. Groups of
fewer than LEAST rows borrow the language's sketch, then the overall one.

Null text has no words (and fails the base rule); null language or source is a
group of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, cut, words

SYMBOLS = "#*$%&|<>"
GAMMA = math.log(1.02)
FENCE = 6.0
LEAST = 50
#: Rule: the smallest spread that counts, as the fence must not cut into plain prose.
RULES = {"symbol_ratio": 0.02, "dup_line_ratio": 0.05, "repeat_ratio": 0.03, "word_length": 0.5, "short_word_length": 0.02}


def repeat_words(ws: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in the text."""
    n = F.size(ws)
    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    grams = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(F.col("_hs"), i + k) for k in range(5)]))
    return hashes, grams


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    body = F.coalesce(df[text], F.lit(""))
    d = df.withColumn("_body", body).withColumn("_ws", words(F.col("_body")))
    n = F.size("_ws")
    bare = F.col("_body")
    for s in SYMBOLS:
        bare = F.replace(bare, F.lit(s), F.lit(""))
    lines = F.filter(F.split("_body", "\n"), lambda x: x.rlike(WORD))
    d = d.withColumns({"n_words": n.cast("long"), "word_chars": F.length(F.array_join("_ws", "")).cast("long"), "n_symbols": (F.length("_body") - F.length(bare)).cast("long"), "_lines": lines})
    hashes, grams = repeat_words(F.col("_ws"))
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    d = d.withColumn("_hs", F.when(n >= 6, hashes)).withColumn("_g", F.when(n >= 6, grams))
    # sorted (window, position): a window is repeated if a neighbour is equal
    pairs = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    d = d.withColumn("_p", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), pairs))
    twice = F.filter(F.transform("_p", lambda p, i: F.when((p["g"] == F.get(F.col("_p"), i - 1)["g"]) | (p["g"] == F.get(F.col("_p"), i + 1)["g"]), p["i"])), lambda x: x.isNotNull())
    d = d.withColumn("_at", F.sort_array(twice))
    covered = F.aggregate(F.transform("_at", lambda x, i: F.least(F.lit(5), F.coalesce(F.get(F.col("_at"), i + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_body", "_ws", "_lines", "_hs", "_g", "_p", "_at")


def ratios() -> dict[str, Column]:
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_dup_lines") + 1, F.col("_n_lines"))
    length = F.col("word_chars") / n
    return {"symbol_ratio": F.col("n_symbols") / n, "dup_line_ratio": F.col("n_dup_lines") / lines, "repeat_ratio": F.col("n_repeat_words") / n, "word_length": length, "short_word_length": 1 / F.greatest(length, F.lit(0.1))}


def bucket(x: Column) -> Column:
    """The sketch's bucket of a value: 0 for 0, else by its logarithm."""
    return F.when(x < 1e-4, F.lit(0)).otherwise(1 + F.floor((F.log(x) - math.log(1e-4)) / GAMMA)).cast("long")


def value(b: Column) -> Column:
    """A bucket's middle."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.exp(math.log(1e-4) + (b - F.lit(0.5)) * GAMMA))


def sketches(d: DataFrame, rules: list[str]) -> DataFrame:
    """Sketch of each rule per (lang, source), per lang and overall: level, lang, source, rule, bucket, n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bucket(F.col(r)).alias("bucket")) for r in rules]))
    fine = d.select("_lang", "_source", pairs.alias("p")).groupBy("_lang", "_source", "p.rule", "p.bucket").agg(F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.array(F.struct(F.lit(0).alias("level"), F.col("_lang").alias("l"), F.col("_source").alias("s")), F.struct(F.lit(1).alias("level"), F.col("_lang").alias("l"), F.lit("").alias("s")), F.struct(F.lit(2).alias("level"), F.lit("").alias("l"), F.lit("").alias("s"))))
    return fine.select(levels.alias("k"), "rule", "bucket", "n").groupBy("k.level", "k.l", "k.s", "rule", "bucket").agg(F.sum("n").alias("n"))


def fences(sk: DataFrame, rules: dict[str, float], fence: float = FENCE) -> DataFrame:
    """Thresholds from sketches: level, l, s, rows, and a limit per rule."""
    by = W.partitionBy("level", "l", "s", "rule")
    c = sk.withColumns({"upto": F.sum("n").over(by.orderBy("bucket")), "rows": F.sum("n").over(by)})
    q = lambda p: F.min(F.when(F.col("upto") >= F.col("rows") * p, value(F.col("bucket"))))
    t = c.groupBy("level", "l", "s", "rule").agg(F.max("rows").alias("rows"), q(0.25).alias("q1"), q(0.75).alias("q3"))
    floor = F.create_map(*[x for r, f in rules.items() for x in (F.lit(r), F.lit(f))])[F.col("rule")]
    t = t.withColumn("limit", F.col("q3") + fence * F.greatest(F.col("q3") - F.col("q1"), floor))
    return t.groupBy("level", "l", "s").agg(F.max("rows").alias("rows"), F.map_from_entries(F.collect_list(F.struct("rule", "limit"))).alias("limits"))


def verdicts(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", rules: dict[str, float] | None = None, fence: float = FENCE, least: int = LEAST) -> DataFrame:
    """A row per document: measures, base_failed, kept, and the rules it failed."""
    rules = rules or RULES
    n_lines = F.size(F.filter(F.split(F.coalesce(df[text], F.lit("")), "\n"), lambda x: x.rlike(WORD)))
    named = lambda c: F.coalesce(F.concat(F.lit("="), df[c].cast("string")), F.lit("null"))
    d = measures(df.select(df[key].alias("_key"), df[text].alias("_text"), named(lang).alias("_lang"), named(source).alias("_source"), n_lines.alias("_n_lines")), "_text").drop("_text")
    d = cut(d.withColumns(ratios()))
    t = cut(fences(sketches(d, list(rules)), rules, fence))
    own = t.filter("level = 0").select(F.col("l").alias("_lang"), F.col("s").alias("_source"), F.struct("rows", "limits").alias("_t0"))
    per = t.filter("level = 1").select(F.col("l").alias("_lang"), F.struct("rows", "limits").alias("_t1"))
    # one row, so it may be broadcast at any size of the input
    top = t.filter("level = 2").select(F.lit(1).alias("_one"), F.struct("rows", "limits").alias("_t2"))
    d = d.withColumn("_one", F.lit(1)).join(own, ["_lang", "_source"], "left").join(per, ["_lang"], "left").join(F.broadcast(top), ["_one"], "left")
    limits = F.when(F.col("_t0.rows") >= least, F.col("_t0.limits")).when(F.col("_t1.rows") >= least, F.col("_t1.limits")).otherwise(F.col("_t2.limits"))
    failed = F.filter(F.array(*[F.when(F.col(r) > limits[r], F.lit(r)) for r in rules]), lambda x: x.isNotNull())
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    d = d.withColumns({"failed_rules": failed, "base_failed": base})
    return d.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")


def keep(df: DataFrame, **how) -> DataFrame:
    """The documents that pass, all columns; `key` must name a unique column."""
    key = how.get("key", "doc_id")
    return df.join(verdicts(df, **how).filter("kept").select(key), key, "left_semi")
