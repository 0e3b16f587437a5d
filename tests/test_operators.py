"""Semantics that the tables do not show, on small fixtures."""

from pyspark.sql import functions as F

from orrery.functions import text as ft
from orrery.operators import attention, calibration, learning, scoring, voting


def test_votes_with_zero_null_and_ties(spark):
    rows = [("a", 0), ("a", 0), ("a", 0), ("b", 1), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("c", 3), ("d", 1), ("d", 1), ("d", 2), ("d", 2), ("e", None)]
    d = spark.createDataFrame(rows, "q string, value int")
    got = {r.q: (r.verdict, r.state) for r in voting.majority(d, ["q"]).collect()}
    assert got == {"a": (0, "ok"), "b": (1, "warn"), "c": (None, "error"), "d": (None, "error")}
    own = spark.createDataFrame([("d", 1)], "q string, value int").limit(0)
    assert {r.q: r.state for r in voting.validator(d, own, ["q"]).collect()} == {"a": "ok", "b": "warn", "c": "error", "d": "warn"}


def test_evidence_counts_repeated_terms_and_best_field(spark):
    f = spark.createDataFrame([(1, "alpha  beta", 1.5), (1, "alpha", 0.8), (2, "al pha", 1.0), (3, None, 1.0)], "k int, text string, pos double")
    d = spark.createDataFrame([("A", "alpha"), ("A", "alpha"), ("B", "alpha beta")], "code string, term string")
    w = spark.createDataFrame([("alpha", 0.5)], "term string, weight double")
    got = {(r.k, r.code): r.matched for r in scoring.evidence(f, d, w, "k").collect()}
    assert got == {(1, "A"): 2, (1, "B"): 1, (2, "A"): 2}


def test_empty_tables(spark):
    f = spark.createDataFrame([], "k int, text string, pos double")
    d = spark.createDataFrame([], "code string, term string")
    w = spark.createDataFrame([], "term string, weight double")
    assert scoring.evidence(f, d, w, "k").count() == 0
    assert voting.majority(spark.createDataFrame([], "q string, value int"), ["q"]).count() == 0


def test_cap_keeps_errors_and_counts_the_rest(spark):
    rows = [(i, f"w{i}", "warn") for i in range(50)] + [(99, "e", "error")]
    got = attention.capped(spark.createDataFrame(rows, "seq int, id string, severity string")).collect()
    assert len(got) == 30 and got[0].severity == "error" and {r.truncated for r in got} == {21}


def test_wilson(spark):
    r = spark.range(1).select(calibration.wilson_low(F.lit(25), F.lit(25)).alias("a"), calibration.wilson_low(F.lit(0), F.lit(0)).alias("b")).first()
    assert r.a == 0.8668 and r.b is None


def test_text(spark):
    d = spark.createDataFrame([("a 　b\r\n c ",)], "t string")
    assert d.select(ft.normalise_space(F.col("t"))).first()[0] == "a b c"
    e = spark.createDataFrame([(["x" * 5, "y" * 20, "z"],)], "p array<string>")
    assert e.select(ft.excerpt(F.col("p"), 20)).first()[0] == "xxxxx" + "y" * 15


def test_learned_terms_absorb_by_substring(spark):
    long = "x" * 80
    rows = [("A", t, 2, 5, 2.0, w, "passed") for t, w in [("bomenteci", 0.9), ("bomente", 0.8), ("ment", 0.7), ("alpha beta", 0.6), ("ha be", 0.5), ("alpha", 0.4), ("bomentecis", 0.3), (long, 0.2), ("xxx", 0.1)]]
    rows += [("B", "bomente", 2, 5, 2.0, 0.5, "passed"), ("B", "bomenteci", 2, 5, 2.0, 0.5, "rare")]
    g = spark.createDataFrame(rows, "code string, term string, a int, df int, lor double, weight double, gate string")
    got = sorted((r.code, r["rank"], r.term) for r in learning.learned(g).collect())
    assert got == [("A", 1, "bomenteci"), ("A", 2, "alpha beta"), ("A", 3, "bomentecis"), ("A", 4, long), ("B", 1, "bomente")]
