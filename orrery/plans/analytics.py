"""Keys, points, symbols and shapes on inline fixtures, and ingest rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import exams
from orrery.functions import text as ft
from orrery.plans.registry import query

_EXAMS = [("2024_수능", 7), ("2023_고3_6월", 12), ("2022_9월", 1), ("broken", 3)]


@query("""SELECT * FROM (VALUES ('2024_수능', 2024, NULL::INTEGER, '수능', '2024_수능_07'), ('2023_고3_6월', 2023, 3, '6월', '2023_고3_6월_12'), ('2022_9월', 2022, NULL, '9월', '2022_9월_01'), ('broken', NULL, NULL, NULL, 'broken_03')) t(exam, year, grade, kind, qid)""")
def exam_keys(spark, sf_dir):
    d = spark.createDataFrame(_EXAMS, "exam string, number int")
    e = F.col("exam")
    return d.select("exam", exams.exam_year(e).alias("year"), exams.exam_grade(e).alias("grade"), exams.exam_kind(e).alias("kind"), exams.qid(e, F.col("number")).alias("qid"))


@query("""SELECT * FROM (VALUES ('[3점]', 3.0::DOUBLE, true), ('[2.5점] x', 2.5, true), ('[2.3점]', 2.3, false), ('none', NULL, NULL)) t(t, points, on_grid)""")
def mark_points(spark, sf_dir):
    d = spark.createDataFrame([("[3점]",), ("[2.5점] x",), ("[2.3점]",), ("none",)], "t string")
    p = exams.mark_points(F.col("t"))
    return d.select("t", p.alias("points"), exams.on_grid(p).alias("on_grid"))


@query("SELECT * FROM (VALUES ('①', 1), ('⑤', 5), (' 3 ', 3), ('7', 0), ('', 0), (NULL, NULL)) t(s, n)")
def choice_symbols(spark, sf_dir):
    d = spark.createDataFrame([("①",), ("⑤",), (" 3 ",), ("7",), ("",), (None,)], "s string")
    return d.select("s", ft.choice_number(F.col("s")).alias("n"))


@query("SELECT * FROM (VALUES ('①②③④⑤', 1), ('①②③④⑤ ①②③④⑤', 2), ('②①③④⑤', 0), ('①② ①②③④⑤', 1)) t(t, runs)")
def choice_run_count(spark, sf_dir):
    d = spark.createDataFrame([("①②③④⑤",), ("①②③④⑤ ①②③④⑤",), ("②①③④⑤",), ("①② ①②③④⑤",)], "t string")
    return d.select("t", ft.choice_runs(F.col("t")).alias("runs"))


@query("SELECT * FROM (VALUES ('가나 ab', 0.5::DOUBLE), ('', 0.0), ('가나', 1.0)) t(t, ratio)")
def hangul_share(spark, sf_dir):
    return spark.createDataFrame([("가나 ab",), ("",), ("가나",)], "t string").select("t", ft.hangul_ratio(F.col("t")).alias("ratio"))


@query("""SELECT * FROM (VALUES ('a', 'problem.pdf'), ('b', 'answer.pdf'), ('c', 'p.pdf'), ('d', NULL)) t(exam, problem)""")
def manifest_shapes(spark, sf_dir):
    """Three shapes of a manifest read into one: files by role as string, as record, or at the top."""
    rows = [("a", '{"files": {"problem": "problem.pdf"}}'), ("b", '{"files": {"problem": {"name": "answer.pdf"}}}'), ("c", '{"problem": "p.pdf"}'), ("d", "not json")]
    d = spark.createDataFrame(rows, "exam string, raw string").withColumn("v", F.try_parse_json("raw"))
    get = lambda p: F.try_variant_get("v", p, "string")
    record = get("$.files.problem.name")
    flat = F.when(record.isNull(), get("$.files.problem"))
    return d.select("exam", F.coalesce(record, flat, get("$.problem")).alias("problem"))
