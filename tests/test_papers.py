"""Papers, tolerant reads and increments on small fixtures."""

import json

from pyspark.sql import functions as F

from orrery.operators import papers
from orrery.sources import tolerant
from orrery.streaming import increments


def test_kinds(spark):
    rows = [(1, ["①②③④⑤ " * 20]), (2, ["정답표 문항 번호"]), (3, ["정답 및 해설", "오답 풀이 출제 의도"]), (4, []), (5, None), (6, ["①②③④⑤" * 20 + "출제 의도" * 3])]
    got = {r.k: r.kind for r in papers.content_kind(spark.createDataFrame(rows, "k int, pages array<string>")).collect()}
    assert got == {1: "problem", 2: "answer", 3: "solution", 4: None, 5: None, 6: None}
    d = spark.createDataFrame([("answer", None), ("answer", "solution"), (None, "problem"), (None, None), ("answer", "answer")], "n string, f string")
    kind, by = papers.settled_kind(F.col("n"), F.col("f"))
    assert [tuple(r) for r in d.select(kind, by).collect()] == [("answer", "name"), ("solution", "content over name"), ("problem", "content"), (None, None), ("answer", "name")]


def test_layers(spark):
    d = spark.createDataFrame([("가" * 600, "x"), ("a" * 600, "y"), ("", "z"), (None, None)], "d string, o string")
    text, mode = papers.chosen_layer(F.col("d"), F.col("o"))
    got = d.select(papers.layer_state(F.col("d"), F.lit(2)), text, mode).collect()
    assert [tuple(r) for r in got] == [("ok", "가" * 600, "direct"), ("garbled", "y", "ocr"), ("empty", "z", "ocr"), ("empty", None, None)]


def test_inline_answers(spark):
    d = spark.createDataFrame([(1, "01. 4 02.5 01. 3\n03.\n4 04. 없음 31. 2 05. 12"), (2, None)], "k int, t string")
    got = {(r.k, r.number): r.answer for r in papers.inline_answers(d, "k", "t", 30).collect()}
    assert got == {(1, 1): 4, (1, 2): 5, (1, 4): 0}


def test_lone_donor(spark):
    rows = [("a", "problem", "phys"), ("a", "answer", None), ("b", "problem", "chem"), ("b", "answer", None), ("b", "answer", None), ("c", "problem", "x"), ("c", "problem", "y"), ("c", "answer", None)]
    got = papers.lone_donor(spark.createDataFrame(rows, "dir string, role string, subject string"), "dir", "role", "subject")
    assert [(r.dir, r.inherited) for r in got.filter("inherited IS NOT NULL").collect()] == [("a", "phys")]


def test_tolerant_reads(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"qid": "q1", "n": 3}))
    (tmp_path / "b.json").write_text("{broken")
    good, bad = tolerant.json_rows(spark, str(tmp_path), "qid string, n int")
    assert [(r.qid, r.n, r.file[-6:]) for r in good.collect()] == [("q1", 3, "a.json")] and [r.id[-6:] for r in bad.collect()] == ["b.json"]
    own, base = spark.createDataFrame([("k", 1)], "k string, v int"), spark.createDataFrame([("k", 2), ("m", 3)], "k string, v int")
    rows, twice = tolerant.overlay([own, base], ["k"])
    assert sorted(tuple(r) for r in rows.collect()) == [("k", 1), ("m", 3)] and [r.id for r in twice.collect()] == ["k"]


def test_increments(spark, tmp_path):
    at = {n: str(tmp_path / n) for n in ("in", "out", "cp")}

    def run():
        increments.increments(spark, at["in"], "k int", at["out"], at["cp"], lambda d: d.withColumn("twice", F.col("k") * 2))
        return sorted((r.k, r.twice) for r in spark.read.parquet(at["out"]).collect())

    spark.createDataFrame([(1,)], "k int").coalesce(1).write.parquet(at["in"])
    assert run() == [(1, 2)]
    spark.createDataFrame([(5,)], "k int").coalesce(1).write.mode("append").parquet(at["in"])
    assert run() == [(1, 2), (5, 10)] and run() == [(1, 2), (5, 10)]


def test_rate_rows_take_a_row_apart_once(spark):
    # filters pushed below the cells would take each row apart again
    got = papers.rate_rows(spark.createDataFrame([(1, "<tr><td>1</td></tr>")], "k int, h string"), "k", "h", 9)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("<td[^>]*>") == 1 and got.count() == 0


def test_rate_table_uses_all_cores(spark):
    from orrery.plans import registry

    plan = registry.queries()["rate_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan


def test_numbers_equal_try_cast(spark):
    from orrery.functions import text as ft

    texts = ["1", " 1.5 ", "+.5", "-2", "1e3", "1E-2", "1d", "2f", "0x1p3", ".", "", "x", "3등", "5.", "\t7\n", "1 2", "1,5", "٣", None, "99%", "-", "1e999"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    r = d.select(ft.number(F.col("t")).alias("a"), F.col("t").try_cast("double").alias("b"), ft.whole(F.col("t")).alias("c"), F.col("t").try_cast("int").alias("d")).collect()
    assert [x.a for x in r] == [x.b for x in r] and [x.c for x in r] == [x.d for x in r] and sum(x.a is not None for x in r) > 9
