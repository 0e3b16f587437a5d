"""Answer sheets, question starts, page layout, files and reconciliation over stand-ins built from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import files
from orrery.operators import layout, reconcile, sheets
from orrery.plans.registry import dealt, query, table

_CIRCLES = "'①②③④⑤'"


@query("""SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS number, CAST(max(CAST(l_quantity AS INTEGER) % 5 + 1) AS INTEGER) AS answer FROM lineitem GROUP BY ALL""")
def columnar_answers(spark, sf_dir):
    """A column of numbers, then a column of answers, per order."""
    d = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey")  # one shuffle for both groups
    d = d.groupBy("l_orderkey", F.col("l_linenumber").cast("int").alias("n")).agg(F.max(F.col("l_quantity").cast("int") % 5 + 1).alias("a"))
    d = d.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", "a"))).alias("c"))
    text = "concat_ws('\n', 'head 7', array_join(transform(c, x -> concat(lpad(x.n, 2, '0'), '.')), '\n'), array_join(transform(c, x -> cast(x.a as string)), '\n'))"
    return sheets.columnar(d.select("l_orderkey", F.expr(text).alias("text")), "l_orderkey", "text", 99)


@query("""SELECT p_partkey, i AS number, CAST(CASE WHEN i = 2 AND p_partkey % 7 = 0 THEN 0 ELSE (p_partkey + i) % 5 + 1 END AS INTEGER) AS answer
FROM part, (VALUES (1), (2), (3), (4)) t(i) WHERE p_partkey % 4 > 0""")
def paired_answers(spark, sf_dir):
    """A page number, then number and answer by turns; every fourth sheet lacks its third number."""
    cell = "concat_ws('\n', IF(i = 3 AND p_partkey % 4 = 0, '9', cast(i as string)), IF(i = 2 AND p_partkey % 7 = 0, '전항 정답', IF(p_partkey % 2 = 0, cast((p_partkey + i) % 5 + 1 as string), substr(%s, cast((p_partkey + i) %% 5 + 1 as int), 1))))".replace("%s", _CIRCLES).replace("%%", "%")
    text = F.expr(f"concat('9\n정답 및 해설\n', array_join(transform(sequence(1, 4), i -> {cell}), '\n'))")
    d = dealt(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", sheets.sheet_tokens(text).alias("t"))
    return sheets.paired(d, "p_partkey", "t", 4)


@query("""SELECT p_partkey, i AS number, CAST((p_partkey + i) % 5 + 1 AS INTEGER) AS answer, CAST(CASE WHEN p_partkey % 2 = 0 THEN 2 + i % 2 END AS INTEGER) AS points
FROM part, (VALUES (1), (2), (3), (4), (5)) t(i)""")
def strided_answers(spark, sf_dir):
    """Cells of number, answer and points, or without points."""
    cell = f"concat(i, ' ', substr({_CIRCLES}, cast((p_partkey + i) % 5 + 1 as int), 1), IF(p_partkey % 2 = 0, concat('\n', 2 + i % 2), ''))"
    text = F.expr(f"concat('문항 정답\n', array_join(transform(sequence(1, 5), i -> {cell}), '\n'))")
    d = dealt(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", sheets.sheet_tokens(text).alias("t"))
    return sheets.cells(d, "p_partkey", "t", 5, sheets.with_or_without_points)


@query("""SELECT p_partkey, i AS number, CAST((p_partkey + i) % 5 + 1 AS INTEGER) AS answer, CAST(NULL AS INTEGER) AS points
FROM part, (VALUES (1), (2), (3), (4)) t(i) WHERE p_partkey % 3 <= 1""")
def circled_answers(spark, sf_dir):
    """Glued or parted cells with a page number among them; two strangers are too many."""
    sign = f"substr({_CIRCLES}, cast((p_partkey + i) % 5 + 1 as int), 1)"
    cell = f"concat(array(), IF(i = 3, IF(p_partkey % 3 = 1, array('88'), IF(p_partkey % 3 = 2, array('88', '89'), array())), array()), IF(i % 2 = 0, array(concat(i, {sign})), array(cast(i as string), {sign})))"
    d = dealt(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", F.expr(f"flatten(transform(sequence(1, 4), i -> {cell}))").alias("t"))
    return sheets.cells(d, "p_partkey", "t", 4, sheets.circled)


@query("""WITH t AS (SELECT p_partkey, '1. ' || p_name || '?' || chr(10) AS a, '2. decoy' || chr(10) || '1 a 2 b 3 c 4 d 5 e' || chr(10) AS b, '2. real?' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '1 a 2 b 3 c 4 d 5 e' ELSE '' END AS c FROM part)
SELECT p_partkey, 1 AS number, 0 AS start, CASE WHEN p_partkey % 2 = 0 THEN a || b ELSE a END AS block FROM t UNION ALL
SELECT p_partkey, 2, CAST(length(CASE WHEN p_partkey % 2 = 0 THEN a || b ELSE a END) AS INTEGER), CASE WHEN p_partkey % 2 = 0 THEN c ELSE b || c END FROM t""")
def question_blocks(spark, sf_dir):
    """A numbered list within the first question is a false start where a better choice exists."""
    text = "concat('1. ', p_name, '?\n2. decoy\n1 a 2 b 3 c 4 d 5 e\n2. real?', IF(p_partkey % 2 = 0, '\n1 a 2 b 3 c 4 d 5 e', ''))"
    return sheets.question_blocks(dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", F.expr(text).alias("t")), "p_partkey", "t", 2)


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' WHEN 2 THEN '.jpg' WHEN 3 THEN '.zip' END AS extension,
  CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 3 < 2 WHEN s_suppkey % 5 IN (1, 2) THEN s_suppkey % 3 = 1 ELSE false END AND s_suppkey % 7 > 0 AS verified FROM supplier""")
def file_types(spark, sf_dir):
    head = "element_at(array('25504446', '89504E470D0A1A0A', 'FFD8', '504B0304', '3C68746D'), cast(s_suppkey % 5 + 1 as int))"
    data = F.expr(f"unhex(concat({head}, repeat('00', IF(s_suppkey % 7 = 0, 64, 2048))))")
    kind = F.expr("element_at(array('problem', 'answer', 'rates'), cast(s_suppkey % 3 + 1 as int))")
    return table(spark, sf_dir, "supplier").select("s_suppkey", files.extension(data).alias("extension"), files.verified(data, kind).alias("verified"))


@query("SELECT * FROM (VALUES ('2020-2022, 2025', '2020,2021,2022,2025'), ('2022-2020', '2020,2021,2022'), ('2024,2024', '2024'), ('', NULL), (NULL, NULL)) t(t, years)")
def year_ranges(spark, sf_dir):
    d = spark.createDataFrame([("2020-2022, 2025",), ("2022-2020",), ("2024,2024",), ("",), (None,)], "t string")
    y = files.years(F.col("t"))
    return d.select("t", F.when(y.isNotNull(), F.array_join(y.cast("array<string>"), ",")).alias("years"))


@query("SELECT * FROM (VALUES ('2024_수능', 4), ('2024_11월학평', 5), ('2024_고2_3월학평', 1), ('2024_고3_3월학평', 2), ('2023_x', 0), ('2024_6월모평', 3)) t(exam, place)")
def exam_chronology(spark, sf_dir):
    from pyspark.sql.window import Window as W

    d = spark.createDataFrame([(e,) for e in ("2024_수능", "2024_11월학평", "2024_고2_3월학평", "2024_고3_3월학평", "2023_x", "2024_6월모평")], "exam string")
    return d.select("exam", (F.row_number().over(W.orderBy(files.exam_order(F.col("exam")))) - 1).alias("place"))


@query("SELECT * FROM (VALUES ('생활과 윤리', '생활과윤리'), ('Physics Ⅰ', 'physicsi'), (' A B ', 'ab'), (NULL, NULL)) t(name, folded)")
def folded_names(spark, sf_dir):
    return spark.createDataFrame([("생활과 윤리",), ("Physics Ⅰ",), (" A B ",), (None,)], "name string").select("name", files.folded("name").alias("folded"))


@query("""SELECT * FROM (VALUES ('"a"', 'a', 1), ('["a", "b"]', 'a|b', 2), ('{"x": 1}', '', 0), ('broken', '', 0), (NULL, '', 0)) t(raw, joined, n)""")
def string_or_list(spark, sf_dir):
    d = spark.createDataFrame([('"a"',), ('["a", "b"]',), ('{"x": 1}',), ("broken",), (None,)], "raw string")
    s = F.coalesce(files.strings(F.col("raw")), F.array().cast("array<string>"))
    return d.select("raw", F.array_join(s, "|").alias("joined"), F.size(s).alias("n"))


@query("""WITH s AS (SELECT DISTINCT p_brand AS subject, p_size % 11 AS prefix FROM part), o AS (SELECT prefix FROM s WHERE subject = (SELECT min(p_brand) FROM part)),
b AS (SELECT DISTINCT subject FROM s WHERE prefix IN (SELECT prefix FROM o))
SELECT DISTINCT p_name || '-' || p_size AS code FROM part WHERE p_name || '-' || p_size NOT IN (SELECT p_name || '-' || p_size FROM part WHERE p_brand IN (SELECT subject FROM b) AND p_size > 40)""")
def sibling_gap(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("code", F.concat_ws("-", "p_name", F.col("p_size").cast("string")))
    subjects = p.groupBy(F.col("p_brand").alias("subject")).agg(F.collect_set(F.col("p_size") % 11).alias("prefixes"))
    used = p.filter("p_size > 40").select(F.col("p_brand").alias("subject"), "code")
    first = p.agg(F.min("p_brand")).first()[0]
    return reconcile.sibling_gaps(p.select("code").distinct(), subjects, used, first)


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority IS NULL OR o_custkey IS NULL THEN 'incomplete' WHEN c_custkey IS NULL THEN 'unknown code' WHEN NOT starts_with(c_mktsegment, 'A') THEN 'out of scope' WHEN l_orderkey IS NULL THEN 'no item' END AS reason
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 25) ON l_orderkey = o_orderkey""")
def apply_reasons(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.lit(True).alias("known"))
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    d = reconcile.flagged(o.join(c, "o_custkey", "left"), li, ["o_orderkey"], "has_item")
    checks = [("incomplete", F.col("o_orderpriority").isNotNull() & F.col("o_custkey").isNotNull()), ("unknown code", F.col("known")), ("out of scope", F.startswith("c_mktsegment", F.lit("A"))), ("no item", F.col("has_item"))]
    return reconcile.with_reason(d, checks).select("o_orderkey", "reason")


@query("""SELECT l_orderkey, CAST(count(*) FILTER (l_returnflag = 'R' AND l_quantity > 30) AS BIGINT) AS n_conflicts, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_returnflag = 'R' AND l_quantity > 30) > 0""")
def guarded_items(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    return reconcile.all_or_nothing(d, "l_orderkey", (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 30))[1]


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30)""")
def guarded_rows(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return reconcile.all_or_nothing(d, "l_orderkey", (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 30))[0].select("l_orderkey", "l_linenumber")


@query("""WITH s AS (SELECT doc_id, length(text) AS n FROM documents WHERE doc_id % 5 > 0), t AS (SELECT doc_id, length(text) + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM documents WHERE doc_id % 7 > 0)
SELECT doc_id, CASE WHEN s.doc_id IS NULL THEN 'delete' WHEN t.doc_id IS NOT NULL AND s.n IS NOT DISTINCT FROM t.n THEN 'keep' ELSE 'copy' END AS action FROM s FULL JOIN t USING (doc_id)""")
def sync_plan(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    t = d.filter("doc_id % 7 > 0").withColumn("n", F.col("n") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0))
    return reconcile.sync_plan(d.filter("doc_id % 5 > 0"), t, ["doc_id"], "n")


@query("""SELECT p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY CASE p_brand WHEN 'Brand#3' THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey) = 1""")
def source_priority(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_brand", "p_retailprice")
    order = [F.when(F.col("p_brand") == "Brand#3", 0).otherwise(1), F.desc("p_retailprice"), F.col("p_partkey")]
    return reconcile.by_priority(p, ["p_type"], order).select("p_type", "p_partkey")


@query("""WITH g AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS d, list(DISTINCT l_returnflag) FILTER (l_quantity > 10) AS a FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(list_filter(d, lambda x: NOT list_contains(coalesce(a, []), x))), ',') AS missing, len(d) = len(coalesce(a, [])) AS same FROM g""")
def declared_files(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("d"), F.collect_set(F.when(F.col("l_quantity") > 10, F.col("l_returnflag"))).alias("a"))
    return reconcile.set_differences(g, "d", "a").select("l_orderkey", F.array_join("missing", ",").alias("missing"), "same")


@query("SELECT coalesce(source, '-') AS source, count(*) AS total, CAST(count(*) FILTER (lang IS NULL) AS BIGINT) AS missing FROM documents GROUP BY 1")
def completeness_by_group(spark, sf_dir):
    return reconcile.completeness(table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("-")).alias("source"), "lang"), "source", "lang")


_BOX = "s_suppkey % 20 AS page, s_suppkey AS box_id, CAST(s_suppkey % 53 AS DOUBLE) AS x0, CAST(s_suppkey * 7 % 960 AS DOUBLE) AS y0, CAST(s_suppkey % 53 + 8 AS DOUBLE) AS x1, CAST(s_suppkey * 7 % 960 + 9 AS DOUBLE) AS y1"


@query(f"""WITH RECURSIVE b AS (SELECT {_BOX} FROM supplier), e AS (SELECT p.page, p.box_id AS i, q.box_id AS j FROM b p JOIN b q USING (page)
  WHERE sqrt(pow(greatest(0, greatest(p.x0, q.x0) - least(p.x1, q.x1)), 2) + pow(greatest(0, greatest(p.y0, q.y0) - least(p.y1, q.y1)), 2)) <= 20),
r(i, root) AS (SELECT box_id, box_id FROM b UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.i)
SELECT b.page, b.box_id, min(r.root) AS cluster FROM b JOIN r ON r.i = b.box_id GROUP BY ALL""")
def box_clusters(spark, sf_dir):
    return layout.box_clusters(table(spark, sf_dir, "supplier").selectExpr(*_BOX.split(", ")), "page", "box_id", 20.0)


@query("""WITH d AS (SELECT p_brand, p_size % 37 * 3 + CASE WHEN p_size % 37 > 18 THEN 40 ELSE 0 END AS x, count(*) AS n FROM part GROUP BY ALL), g AS (SELECT *, CASE WHEN x - lag(x) OVER w <= 4 THEN 0 ELSE 1 END AS s FROM d WINDOW w AS (PARTITION BY p_brand ORDER BY x)),
c AS (SELECT *, sum(s) OVER (PARTITION BY p_brand ORDER BY x) AS cluster FROM g)
SELECT p_brand, CAST(cluster AS BIGINT) AS cluster, min(x) AS min_x, arg_max(x, n * 1000 - x) AS modal_x, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL""")
def column_clusters(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_brand", "p_size % 37 * 3 + CASE WHEN p_size % 37 > 18 THEN 40 ELSE 0 END AS x")
    return layout.column_clusters(p, "p_brand", "x", 4)


@query("""WITH r AS (SELECT l_returnflag AS doc, l_linenumber AS page, l_partkey % 2000 AS x FROM lineitem), a AS (SELECT doc, count(DISTINCT page) AS n FROM r GROUP BY 1)
SELECT doc, x, count(DISTINCT page) AS n_pages FROM r JOIN a USING (doc) GROUP BY doc, x, n HAVING count(DISTINCT page) >= 0.5 * n""")
def rules_on_many_pages(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS doc", "l_linenumber AS page", "l_partkey % 2000 AS x")
    return layout.on_many_pages(li, "doc", "page", "x")


@query("""WITH l AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN [1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 9] WHEN 1 THEN [7, 1, 2, 3, 4, 5] ELSE [1, 2, 4] END AS a FROM part)
SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 1 END AS INTEGER) AS place FROM l""")
def last_label_window(spark, sf_dir):
    a = F.expr("CASE p_partkey % 3 WHEN 0 THEN array(1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 9) WHEN 1 THEN array(7, 1, 2, 3, 4, 5) ELSE array(1, 2, 4) END")
    return table(spark, sf_dir, "part").select("p_partkey", layout.last_label_window(a).alias("place"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS pos FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_returnflag) = 1),
p AS (SELECT * EXCLUDE pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS pos FROM l)
SELECT l_orderkey, l_linenumber, (SELECT arg_max(t.l_suppkey, t.pos) FROM p t WHERE t.l_orderkey = s.l_orderkey AND t.pos BETWEEN s.pos - 4 AND s.pos - 1 AND t.l_returnflag <> 'N') AS title FROM p s WHERE l_linenumber % 3 = 0""")
def nearest_titles(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey")
    li = reconcile.by_priority(li, ["l_orderkey", "l_linenumber"], [F.col("l_suppkey"), F.col("l_returnflag")])
    return layout.nearest_title(li, "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_linenumber") % 3 == 0, F.col("l_returnflag") != "N")


@query("""SELECT l_linestatus, CAST(count(*) FILTER (b) AS BIGINT) AS n_bulk FROM (SELECT l_linestatus, h IS NULL AND count(*) FILTER (h IS NULL) OVER (PARTITION BY l_orderkey) > 2 AS b FROM (SELECT l_orderkey, l_linestatus, CASE WHEN l_quantity > 20 THEN 1 END AS h FROM lineitem)) GROUP BY 1""")
def bulk_exports(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", F.when(F.col("l_quantity") > 20, 1).alias("h"))
    return layout.demoted(d, "l_orderkey", "h").groupBy("l_linestatus").agg(F.count_if("bulk").alias("n_bulk"))


@query("""WITH c AS (SELECT CAST(57344 + p_partkey % 40 AS INTEGER) AS code, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS k FROM part) SELECT code, CAST(sum(k) AS BIGINT) AS n, count(*) AS n_texts FROM c GROUP BY 1""")
def private_use_histogram(spark, sf_dir):
    sign = "decode(unhex(hex(57344 + p_partkey % 40)), 'UTF-16BE')"
    return layout.characters(table(spark, sf_dir, "part").select(F.expr(f"concat(p_name, repeat({sign}, IF(p_partkey % 3 = 0, 2, 1)))").alias("t")), "t")
