"""Paper operators over stand-ins built from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import papers
from orrery.plans.registry import dealt, query, table

_TAIL = "CASE doc_id % 4 WHEN 0 THEN repeat('①②③④⑤ ', 12) WHEN 1 THEN repeat('정답 및 해설 ', 4) WHEN 2 THEN '정답표 정답표' ELSE '' END"


@query(f"""WITH p AS (SELECT doc_id, string_split(coalesce(text, '') || chr(10) || {_TAIL}, chr(10)) AS pages FROM documents),
t AS (SELECT doc_id, len(pages) AS n, array_to_string(pages, '') AS t FROM p),
c AS (SELECT doc_id, t, CAST(len(regexp_extract_all(regexp_replace(t, '[^①-⑤]', '', 'g'), '①②③④⑤')) AS INTEGER) AS runs,
  CAST(len(regexp_extract_all(t, '{papers.SOLUTION_HEADING}')) AS INTEGER) AS solution_marks,
  CAST(len(regexp_extract_all(t, '{papers.ANSWER_HEADING}')) AS INTEGER) AS answer_marks, CAST(length(t) // n AS INTEGER) AS page_chars FROM t),
v AS (SELECT *, answer_marks >= 2 AND solution_marks = 0 AND runs <= 2 AND page_chars <= 600 AS a, solution_marks >= 3 AND runs <= 5 AS s, runs >= 10 AND answer_marks < 2 AND solution_marks < 3 AS q FROM c)
SELECT doc_id, runs, solution_marks, answer_marks, page_chars, CASE WHEN a::INT + s::INT + q::INT = 1 THEN CASE WHEN a THEN 'answer' WHEN s THEN 'solution' ELSE 'problem' END END AS kind FROM v""")
def content_kind(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.expr(_TAIL)), "\n").alias("pages"))
    return papers.content_kind(d).drop("pages")


@query("""SELECT l_orderkey, l_linenumber AS number, CAST(max(CAST(l_quantity AS INTEGER) % 5 + 1) AS INTEGER) AS answer FROM lineitem GROUP BY ALL""")
def inline_answers(spark, sf_dir):
    one = F.expr("concat(lpad(n, 2, '0'), '. ', a)")
    d = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey")
    d = d.groupBy("l_orderkey", F.col("l_linenumber").cast("string").alias("n")).agg(F.max(F.col("l_quantity").cast("int") % 5 + 1).cast("string").alias("a"))
    d = d.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(one)), "  ").alias("t"))
    return papers.inline_answers(d, "l_orderkey", "t", 99).withColumn("number", F.col("number").cast(table(spark, sf_dir, "lineitem").schema["l_linenumber"].dataType))


_RATE = "CAST(p_partkey % 41 + 20 AS DOUBLE)"


@query(f"""SELECT p_partkey, 7 AS number, 3 AS rank, {_RATE} AS error_rate, 2.5::DOUBLE AS points, CAST(p_size % 5 + 1 AS INTEGER) AS answer, CASE WHEN p_partkey % 3 > 0 THEN 100 - {_RATE} END AS answer_share FROM part""")
def rate_table(spark, sf_dir):
    """A page per part; every third one's shares do not prove themselves."""
    share = "transform(sequence(1, 5), i -> concat('<td>', IF(i = p_size % 5 + 1, 100 - p_partkey % 41 - 20 - IF(p_partkey % 3 = 0, 5, 0), (p_partkey % 41 + 20) / 4D), '%</td>'))"
    row = f"concat('<tr class=a>\n<td>3</td><td>7</td><td>', p_partkey % 41 + 20, '</td><td>2.5</td><td><b>', substring('①②③④⑤', CAST(p_size % 5 + 1 AS INT), 1), '</b></td><td>x</td>', array_join({share}, ''), '<td>more</td></tr>')"
    page = F.expr(f"concat('<table><tr><td>3</td><td>7</td></tr>', {row}, replace({row}, '<td>3<', '<td>9<'), '</table>')")
    got = papers.rate_rows(dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", page.alias("html")), "p_partkey", "html", 25)
    return got.withColumn("answer_share", F.element_at("choices", F.col("answer"))).drop("choices")


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 = 0 OR l_linenumber % 2 = 0 THEN 3.0 WHEN l_orderkey % 5 = 0 AND l_linenumber = 1 THEN 1.5 END AS mark FROM lineitem),
t AS (SELECT l_orderkey, count(*) AS n, count(mark) AS m, coalesce(sum(mark), 0) AS s, count(DISTINCT mark) AS kinds, max(mark) AS tier FROM q GROUP BY 1),
b AS (SELECT *, CAST(CASE WHEN l_orderkey % 7 = 0 THEN 3 ELSE 2 END AS DOUBLE) * (n - m) + 3.0 * m AS total FROM t),
r AS (SELECT *, (total - s) / nullif(n - m, 0) AS base FROM b),
x AS (SELECT *, CASE WHEN m = n THEN CASE WHEN abs(s - total) > 1e-6 THEN 'sum differs' END WHEN kinds > 1 THEN 'several tiers' WHEN total <= s THEN 'nothing left' WHEN abs(base / 0.5 - round(base / 0.5)) > 1e-6 THEN 'off grid' WHEN kinds = 1 AND abs(base - tier) <= 1e-6 THEN 'base equals mark' END AS reason FROM r)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN reason IS NULL THEN coalesce(mark, base) END AS DOUBLE) AS points, reason FROM q JOIN x USING (l_orderkey)""")
def points_by_marks(spark, sf_dir):
    mark = F.expr("CAST(CASE WHEN l_orderkey % 4 = 0 OR l_linenumber % 2 = 0 THEN 3.0 WHEN l_orderkey % 5 = 0 AND l_linenumber = 1 THEN 1.5 END AS DOUBLE)")
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", mark.alias("mark"))
    t = d.groupBy("l_orderkey").agg(F.expr("IF(l_orderkey % 7 = 0, 3D, 2D) * (count(1) - count(mark)) + 3D * count(mark)").alias("total"))
    return papers.points_by_marks(d.join(t, "l_orderkey"), "l_orderkey", "l_linenumber", "mark", "total")


_ROW = "p_partkey % 20 AS page, p_partkey AS row_id, CAST(p_size AS DOUBLE) AS x0, CAST(p_partkey % 97 * 10 AS DOUBLE) AS y0, CAST(p_size + 10 AS DOUBLE) AS x1, CAST(p_partkey % 97 * 10 + 8 AS DOUBLE) AS y1"
_BOX = "s_suppkey % 20 AS page, s_suppkey AS box_id, CAST(s_suppkey % 53 AS DOUBLE) AS x0, CAST(s_suppkey * 7 % 960 AS DOUBLE) AS y0, CAST(s_suppkey % 53 + 8 AS DOUBLE) AS x1, CAST(s_suppkey * 7 % 960 + 9 AS DOUBLE) AS y1"


@query(f"""WITH r AS (SELECT {_ROW} FROM part), b AS (SELECT {_BOX} FROM supplier)
SELECT row_id, box_id FROM r JOIN b USING (page) WHERE (b.y0 + b.y1) / 2 BETWEEN r.y0 - 2 AND r.y1 + 2
  AND least(r.x1, b.x1) - greatest(r.x0, b.x0) > 0.5 * least(r.x1 - r.x0, b.x1 - b.x0)""")
def box_overlap(spark, sf_dir):
    cut = lambda name, cols: table(spark, sf_dir, name).selectExpr(*cols.split(", "))
    return papers.overlaps(cut("part", _ROW), cut("supplier", _BOX), ["page"])


@query(f"""WITH b AS (SELECT {_BOX} FROM supplier) SELECT page, string_agg('b' || box_id, chr(10) ORDER BY least(floor((x0 + x1) / 2 / 60 * 2), 1), y0, x0, 'b' || box_id) AS text FROM b GROUP BY page""")
def page_order(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").selectExpr(*_BOX.split(", ")).selectExpr("page", "x0", "x1", "y0 AS y", "60D AS width", "concat('b', box_id) AS text")
    return papers.page_order(d, ["page"], 2)
