"""Text normalisation, stems and record shapes against plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from orrery.functions import exams, korean
from orrery.operators import items, learning, scoring, sheets


def normalised(t):
    table = dict(zip(*korean.glyphs()))
    t = "".join(table.get(c, c) for c in unicodedata.normalize("NFKC", t or "").replace("\xa0", " "))
    t = "".join(c for c in t if c in "\n\t" or not (ord(c) < 32 or 0x80 <= ord(c) <= 0x9F or 0xE000 <= ord(c) <= 0xF8FF))
    t = re.sub(r"<\s*보\s*기\s*>", "<보기>", t)
    t = re.sub(r" ?\n ?", "\n", re.sub(r"[ \t]+", " ", t))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def test_normalised(spark):
    texts = [None, "", "ⅠⅡ ＡＢ½", "  x", "a\xa0b\x01\x85c", "< 보\n기 >", " x \n \n\n\n y\t\tz ", "ᄀ ᄇ"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(korean.normalised(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [normalised(t) for t in texts]


def test_stems_and_terms(spark):
    d = spark.createDataFrame([("지진파에서는 바다 지진파가 2024 판이",)], "t string")
    assert set(d.select(korean.stemmed_terms(F.col("t"))).first()[0]) == {"지진파", "바다", "판이", "지진파 바다", "바다 지진파", "지진파 판이"}
    for t, want in [("해수의", ("해수의", False)), ("지층에서", ("지층", True)), ("물을", ("물을", False)), ("암석", ("암석", False))]:
        assert tuple(d.select(korean.noun_stem(F.lit(t)).alias("s")).first().s) == want


@pytest.mark.parametrize("t, points", [("[ 3 점 ]", 3.0), ("[2.5점] x", 2.5), ("3점", None), (None, None)])
def test_mark_points(spark, t, points):
    assert spark.range(1).select(exams.mark_points(F.lit(t).cast("string"))).first()[0] == points


def test_keys(spark):
    assert spark.range(1).select(exams.qid_exam(F.lit("broken")), exams.qid_exam(F.lit("2024_수능_07"))).first()[:] == (None, "2024_수능")


def test_ordered_union_keeps_order(spark):
    assert spark.range(1).select(items.ordered_union(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("c"), F.lit(None), F.lit("b")), F.lit(None).cast("array<string>"))).first()[0] == ["b", "a", "c"]


def test_public_drops_hidden_columns(spark):
    assert items.public(spark.range(1).selectExpr("id", "id AS _x")).columns == ["id"]


@pytest.mark.parametrize("first", [2000, 2])
def test_learned_absorbs_by_string(spark, first):
    rows = [("c", t, 5, 5, 2.0, w, "passed") for t, w in [("sandstone", 0.9), ("sand", 0.8), ("stone bed", 0.7), ("bed", 0.6), ("river", 0.5), ("one", 0.4), ("iver", 0.3), ("lake", 0.2)]] + [("d", "sand", 5, 5, 2.0, 0.1, "passed")]
    g = spark.createDataFrame(rows, "code string, term string, a long, df long, lor double, weight double, gate string")
    got = sorted((r.code, r["rank"], r.term) for r in learning.learned(g, cap=3, first=first).collect())
    assert got == [("c", 1, "sandstone"), ("c", 2, "stone bed"), ("c", 3, "river"), ("d", 1, "sand")]


def test_question_starts_above_the_budget():
    text = "\n".join(f"{i}. what?\n① ② ③ ④ ⑤" for i in range(1, 6))
    assert sheets.question_starts(text, 5, budget=1) == sheets.question_starts(text, 5) and sheets.question_starts(text, 6) is None


def test_large_dictionaries_take_several_passes(spark, monkeypatch):
    d = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta")], "id long, text string")
    k = spark.createDataFrame([("alpha",), ("beta",), ("gamma",), ("delta",)], "term string")
    want = sorted(map(tuple, scoring.document_frequency(d, k, "text").collect()))
    monkeypatch.setattr(scoring, "MAX_TERMS", 2)
    assert sorted(map(tuple, scoring.document_frequency(d, k, "text").collect())) == want and len(want) >= 3


def test_stemmed_terms_equal_stem_by_stem(spark):
    r = random.Random(4)
    pieces = ["에서는", "는", "이", "와의", "12", "7", "a", "Bc", "판", "바다", "으로", " ", " ", ".", "_", "Ω", "라"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 25))) for _ in range(500)]

    def stem(w):
        p = next((p for p in korean.TERM_PARTICLES if len(w) > len(p) + 1 and w.endswith(p)), "")
        return w[: len(w) - len(p)]

    def want(t):
        ws = [w for w in map(stem, re.findall("[가-힣A-Za-z0-9]+", t)) if len(w) >= 2 and not re.fullmatch("[0-9]+", w)]
        return {*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))}

    d = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(korean.stemmed_terms(F.col("t")).alias("x"))
    got = [x.x for x in d.collect()]
    assert all(len(x) == len(set(x)) for x in got) and [set(x) for x in got] == [*map(want, texts), set()]
    # every token was held against every particle, three times over
    assert "endswith" not in d._jdf.queryExecution().optimizedPlan().toString().lower()


def test_terms_equal_word_by_word(spark):
    from orrery.functions import text as ft
    from orrery.operators import learning

    r = random.Random(6)
    pieces = ["1", "23", "a", "Bc", "판", "바다", " ", " ", ".", "Ω"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 15))) for _ in range(500)]
    words = [[w for w in re.findall("[가-힣A-Za-z0-9]+", t) if len(w) >= 2 and not w.isdigit()] for t in texts]
    d = spark.createDataFrame([(t, "c") for t in texts], "t string, label string")
    got = d.select(ft.tokens(F.col("t")).alias("w"), ft.terms(F.col("t")).alias("s"), ft.has_tokens(F.col("t")).alias("any")).collect()
    assert [x.w for x in got] == words and [x["any"] for x in got] == [w != [] for w in words]
    assert [sorted(x.s) for x in got] == [sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}) for w in words]
    # the texts were taken apart again to count each class's documents, and df joined back
    c = learning.contingency(d.withColumn("k", F.lit(1)), "k", "t", "label")
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("Join") == 1
    assert {x.n_c for x in c.collect()} == {sum(map(bool, words))}


def test_composition_of_any_text(spark):
    texts = ["plain", "é판漢か", "é", "각", "ㄱ①", "が", "가", None, ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(korean.nfkc(F.col("t")).alias("n")).collect()
    assert [x.n for x in got] == [t and unicodedata.normalize("NFKC", t) for t in texts]


def test_composition_bounds_batches_by_bytes(spark):
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(bound)
    try:
        spark.conf.set(bound, str(256 << 20))
        korean.nfkc(F.col("t"))
        assert int(spark.conf.get(bound)) <= 4 << 20
    finally:
        spark.conf.set(bound, before)
