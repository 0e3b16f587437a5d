"""Keyword scoring: document frequency, smoothed IDF, noisy-OR evidence, ranking."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orrery.functions.text import normalise_space, round4

CEILING, FLOOR, GAP = 0.97, 1e-12, 0.15
#: Terms carried to a task at once; a larger dictionary takes several passes.
MAX_TERMS = 20_000


def matcher(terms: list[str]):
    """An Arrow function from texts to the indices of the terms each holds, as text or without spaces.

    One automaton over all terms reads each text once, so the cost follows the
    text, not text times terms. The dictionary is configuration, not data; its
    size is checked before it is carried.
    """
    if len(terms) > MAX_TERMS:
        raise ValueError(f"{len(terms)} terms exceed {MAX_TERMS}; split the dictionary")

    @F.arrow_udf("array<int>")
    def find(texts: pa.Array) -> pa.Array:
        import ahocorasick

        plain, packed = ahocorasick.Automaton(), ahocorasick.Automaton()
        for a, of in ((plain, terms), (packed, [t.replace(" ", "") for t in terms])):
            same: dict[str, list[int]] = {}
            for i, t in enumerate(of):
                same.setdefault(t, []).append(i)
            for t, ids in same.items():
                if t:
                    a.add_word(t, ids)
            a.make_automaton()
        out = []
        for t in texts.to_pylist():
            got: set[int] = set()
            if t and len(plain):
                for _, ids in plain.iter(t):
                    got.update(ids)
                for _, ids in packed.iter(t.replace(" ", "")):
                    got.update(ids)
            out.append(sorted(got))
        return pa.array(out, pa.list_(pa.int32()))

    return find


def _matches(texts: DataFrame, dictionary: DataFrame, columns: list[str], text: str) -> tuple[DataFrame, list[str]]:
    """columns and `term` for each term a row's text holds."""
    terms = [r[0] for r in dictionary.select("term").distinct().orderBy("term").collect()]
    t = normalise_space(F.coalesce(F.col(text), F.lit("")))
    out = None
    for i in range(0, max(len(terms), 1), MAX_TERMS):
        part = terms[i : i + MAX_TERMS] or [""]
        hit = texts.select(*columns, F.explode(matcher(part)(t)).alias("_i"))
        hit = hit.select(*columns, F.element_at(F.array(*[F.lit(x) for x in part]), F.col("_i") + 1).alias("term"))
        out = hit if out is None else out.unionByName(hit)
    return out, terms


def document_frequency(docs: DataFrame, dictionary: DataFrame, text: str) -> DataFrame:
    """term, df: documents that hold the term, as text or without spaces."""
    hit, _ = _matches(docs, dictionary, [], text)
    hit = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return dictionary.select("term").distinct().join(hit, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def idf(df_counts: DataFrame, n_docs: int) -> DataFrame:
    """(ln((N+1)/(df+1))+1) / (ln(N+1)+1)."""
    n = float(n_docs)
    return df_counts.withColumn("idf", (F.log((n + 1) / (F.col("df") + 1)) + 1) / (F.log(F.lit(n + 1)) + 1))


def evidence(fields: DataFrame, dictionary: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """key, code, evidence, matched.

    fields: key, text, pos (weight of the field); dictionary: code, term;
    weights: term, weight (missing: 1). Per (key, code, term) the best field
    counts; repeated terms of a code count as often as they are listed.
    """
    terms = dictionary.groupBy("code", "term").agg(F.count(F.lit(1)).alias("times")).join(weights.select("term", "weight"), "term", "left").select("code", "term", "times", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    hit, _ = _matches(fields, dictionary, [key, "pos"], "text")
    # the dictionary is small and checked, so its side is broadcast
    best = hit.groupBy(key, "term").agg(F.max("pos").alias("pos")).join(F.broadcast(terms), "term")
    w = F.least(F.lit(CEILING), F.col("weight") * F.col("pos"))
    # -ln of the product of (1 - w), which is kept at FLOOR at least
    return best.groupBy(key, "code").agg(F.least(F.sum(-F.log(1 - w) * F.col("times")), -F.log(F.lit(FLOOR))).alias("evidence"), F.sum("times").alias("matched"))


def scores(ev: DataFrame, key: str) -> DataFrame:
    """Evidence share times (1 - e^-evidence), rounded before it is ranked."""
    share = F.col("evidence") / F.sum("evidence").over(W.partitionBy(key))
    return ev.withColumn("score", round4(share * (1 - F.exp(-F.col("evidence")))))


def ranked(sc: DataFrame, key: str, k: int = 3) -> DataFrame:
    by = W.partitionBy(key).orderBy(F.col("score").desc(), "code")
    return sc.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def queue_reasons(docs: DataFrame, sc: DataFrame, key: str, n_codes: int, threshold: float, gap: float = GAP) -> DataFrame:
    """key, top, second, reasons: why a document is not confirmed; reasons may co-occur.

    Every code ranks, also without a match: with two codes or more the
    runner-up scores 0 at least.
    """
    top2 = ranked(sc, key, 2).groupBy(key).agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    d = docs.select(key).join(top2, key, "left")
    none = F.col("top").isNull()
    top, second = F.coalesce("top", F.lit(0.0)), F.coalesce("second", F.lit(0.0))
    close = ~none & F.lit(n_codes >= 2) & (round4(top - second) < gap)
    reasons = F.array_compact(F.array(F.when(none, F.lit("no_match")), F.when(top < threshold, F.lit("low_top")), F.when(close, F.lit("close_gap"))))
    return d.select(key, top.alias("top"), second.alias("second"), F.array_join(reasons, ",").alias("reasons"))
