"""Items, points, particles, label sets and records, on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import exams, korean
from orrery.operators import items
from orrery.plans.registry import query, table


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


@query("""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  coalesce(text, ''), '[\\x00-\\x08\\x0B-\\x1F]', '', 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))) AS digest FROM documents""")
def text_normalised(spark, sf_dir):
    """SF3; these tables hold no character that composition or glyph tables change, tests cover those."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(korean.normalised(F.col("text")), "UTF-8")).alias("digest"))


@query(f"""WITH t AS (SELECT n_nationkey, replace(n_name, ' ', '') || p AS token FROM nation, (SELECT unnest({_sql_list(korean.TERM_PARTICLES)}) AS p) UNION ALL SELECT n_nationkey, substr(n_name, 1, 1) || p FROM nation, (SELECT unnest({_sql_list(korean.TERM_PARTICLES)}) AS p))
SELECT n_nationkey, token, substr(token, 1, length(token) - coalesce(length(list_filter({_sql_list(korean.TERM_PARTICLES)}, lambda p: length(token) > length(p) + 1 AND ends_with(token, p))[1]), 0)) AS stem FROM t""")
def particle_stems(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("p", F.explode(F.array(*[F.lit(p) for p in korean.TERM_PARTICLES])))
    whole = n.select("n_nationkey", F.concat(F.replace("n_name", F.lit(" "), F.lit("")), "p").alias("token"))
    d = whole.unionByName(n.select("n_nationkey", F.concat(F.substring("n_name", 1, 1), "p").alias("token")))
    return d.select("n_nationkey", "token", korean.stem(F.col("token")).alias("stem"))


_NOUN = sorted(korean.NOUN_PARTICLES, key=len, reverse=True)


@query(f"""WITH t AS (SELECT n_nationkey, replace(n_name, ' ', '') || p AS token FROM nation, (SELECT unnest({_sql_list([*_NOUN, "의"])}) AS p)),
s AS (SELECT *, list_filter({_sql_list(_NOUN)}, lambda p: length(token) - length(p) >= 2 AND ends_with(token, p))[1] AS p FROM t)
SELECT n_nationkey, token, CASE WHEN p IS NULL OR (ends_with(token, '의') AND length(token) > 2) THEN token ELSE substr(token, 1, length(token) - length(p)) END AS stem,
  NOT (p IS NULL OR (ends_with(token, '의') AND length(token) > 2)) AS ends FROM s""")
def noun_stems(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("p", F.explode(F.array(*[F.lit(p) for p in [*_NOUN, "의"]])))
    d = n.select("n_nationkey", F.concat(F.replace("n_name", F.lit(" "), F.lit("")), "p").alias("token"))
    return d.withColumn("s", korean.noun_stem(F.col("token"))).select("n_nationkey", "token", "s.stem", "s.ends")


@query(f"""WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[가-힣A-Za-z0-9]+'),
  lambda t: substr(t, 1, length(t) - coalesce(length(list_filter({_sql_list(korean.TERM_PARTICLES)}, lambda p: length(t) > length(p) + 1 AND ends_with(t, p))[1]), 0))), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+')) AS ws FROM documents)
SELECT term, CAST(count(*) AS BIGINT) AS df FROM (SELECT unnest(list_distinct(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])))) AS term FROM w) GROUP BY term HAVING count(*) > 1""")
def stemmed_term_frequency(spark, sf_dir):
    """SF11 with particles; these tables' letters need no NFKC."""
    d = table(spark, sf_dir, "documents").select(F.explode(korean.stemmed_terms(F.col("text"))).alias("term"))
    return d.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")


@query(r"""SELECT p_partkey, t, CAST(nullif(regexp_extract(t, '\[\s*(\d+(?:\.\d+)?)\s*점\s*\]', 1), '') AS DOUBLE) AS points FROM (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '[' || p_size || '점]' WHEN 1 THEN '[ ' || p_size || '.5 점 ] x' WHEN 2 THEN '[' || p_size || ']' ELSE ' [' || p_size || chr(9) || '점]' END AS t FROM part)""")
def part_marks(spark, sf_dir):
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    mark = F.when(k == 0, F.concat(F.lit("["), n, F.lit("점]"))).when(k == 1, F.concat(F.lit("[ "), n, F.lit(".5 점 ] x"))).when(k == 2, F.concat(F.lit("["), n, F.lit("]"))).otherwise(F.concat(F.lit(" ["), n, F.lit("\t점]")))
    d = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", mark).alias("t"))
    return d.select("p_partkey", "t", exams.mark_points(F.col("t")).alias("points"))


_CELLS = "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN ' ' || CAST(l_quantity AS INTEGER) || ' ' WHEN 1 THEN CAST(l_quantity AS INTEGER) || '.5' WHEN 2 THEN CAST(l_quantity AS INTEGER) || '%' ELSE l_returnflag || CAST(l_quantity AS INTEGER) END AS cell FROM lineitem"


def _cells(spark, sf_dir):
    q, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 4
    cell = F.when(k == 0, F.concat(F.lit(" "), q, F.lit(" "))).when(k == 1, F.concat(q, F.lit(".5"))).when(k == 2, F.concat(q, F.lit("%"))).otherwise(F.concat("l_returnflag", q))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell"))


@query(rf"""SELECT l_orderkey, l_linenumber, CASE WHEN v > 0 AND v <= 10 THEN v END AS points, CASE WHEN r BETWEEN 0 AND 100 THEN r END AS ratio, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS label
FROM (SELECT *, CASE WHEN regexp_full_match(trim(cell), '\d+(?:\.\d+)?') THEN CAST(trim(cell) AS DOUBLE) END AS v, TRY_CAST(rtrim(trim(cell), '%') AS DOUBLE) AS r FROM ({_CELLS}))""")
def table_cells(spark, sf_dir):
    """NF2, NF8 and NF3 on cells that are numbers, percentages or neither."""
    c = F.col("cell")
    number = F.when(F.btrim(c).rlike(r"^\d+(?:\.\d+)?$"), F.btrim(c).cast("double"))
    return _cells(spark, sf_dir).select("l_orderkey", "l_linenumber", exams.cell_points(c).alias("points"), exams.cell_ratio(c).alias("ratio"), exams.points_label(number).alias("label"))


_ITEMS = "SELECT l_orderkey AS exam, l_orderkey || '_' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS qid, l_quantity FROM lineitem"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("exam"), F.concat_ws("_", F.col("l_orderkey").cast("string"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0")).alias("qid"), "l_quantity")


def _tokens(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_orderkey").cast("string").alias("token"))
    return o.union(_items(spark, sf_dir).filter("l_quantity = 50").select("qid"))


_TOKENS = f"tok AS (SELECT CAST(o_orderkey AS VARCHAR) AS token FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT qid FROM ({_ITEMS}) WHERE l_quantity = 50)"


@query(f"WITH {_TOKENS} SELECT CAST(exam AS VARCHAR) AS exam, qid FROM ({_ITEMS}) WHERE qid IN (SELECT token FROM tok) OR CAST(exam AS VARCHAR) IN (SELECT token FROM tok)")
def selected_items(spark, sf_dir):
    return items.selected(_items(spark, sf_dir), _tokens(spark, sf_dir)).select("exam", "qid")


@query(f"WITH {_TOKENS} SELECT DISTINCT CAST(exam AS VARCHAR) AS exam FROM ({_ITEMS}) WHERE qid IN (SELECT token FROM tok) OR CAST(exam AS VARCHAR) IN (SELECT token FROM tok)")
def wanted_exams(spark, sf_dir):
    return items.wanted_exams(_items(spark, sf_dir), _tokens(spark, sf_dir))


_FULL = """full_items AS (SELECT o_orderkey AS qid, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN o_orderpriority || ' [' || (o_orderkey % 3 + 1) || '점]' ELSE o_orderpriority END AS stem,
  CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END AS boxed, CASE WHEN o_orderkey % 6 > 0 THEN coalesce(cs, []) ELSE [] END AS choices, CASE WHEN o_custkey % 3 = 0 THEN 'because ' || o_orderstatus END AS solution,
  CAST(CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 5 ELSE o_orderkey % 3 + 1 END AS DOUBLE) AS points, CASE WHEN o_custkey % 11 = 0 THEN 'vision' ELSE 'text' END AS mode, CASE WHEN o_custkey % 4 = 0 THEN 'image' END AS choices_source
  FROM orders LEFT JOIN (SELECT l_orderkey, list(l_returnflag || l_linenumber ORDER BY l_linenumber, l_returnflag) AS cs FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey)"""


def _full(spark, sf_dir):
    cs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("c")))).alias("cs"))
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "qid").join(cs, "qid", "left")
    third = F.col("qid") % 3 + 1
    return o.select(
        "qid",
        F.when(F.col("qid") % 5 == 0, "").when(F.col("qid") % 5 == 1, F.concat("o_orderpriority", F.lit(" ["), third.cast("string"), F.lit("점]"))).otherwise(F.col("o_orderpriority")).alias("stem"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).alias("boxed"),
        F.coalesce(F.when(F.col("qid") % 6 > 0, F.transform("cs", lambda x: x["c"])), F.array().cast("array<string>")).alias("choices"),
        F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("because "), "o_orderstatus")).alias("solution"),
        F.when(F.col("qid") % 7 == 0, F.lit(None)).when(F.col("qid") % 7 == 1, 5).otherwise(third).cast("double").alias("points"),
        F.when(F.col("o_custkey") % 11 == 0, "vision").otherwise("text").alias("mode"),
        F.when(F.col("o_custkey") % 4 == 0, "image").alias("choices_source"),
    )


@query(f"""WITH {_FULL} SELECT qid, concat_ws(' ', nullif(stem, ''), boxed, CASE WHEN len(choices) > 0 THEN array_to_string(choices, ' / ') END, solution) AS text,
  CAST((stem <> '')::INT + (boxed IS NOT NULL)::INT + (len(choices) > 0)::INT + (solution IS NOT NULL)::INT AS INTEGER) AS n_fields FROM full_items""")
def item_fields(spark, sf_dir):
    """PF4 and PF5."""
    d = _full(spark, sf_dir).withColumn("f", items.fields(F.col("stem"), F.col("boxed"), F.col("choices"), F.col("solution")))
    return d.select("qid", items.item_text(F.col("f")).alias("text"), F.size("f").alias("n_fields"))


@query(rf"""WITH {_FULL}, m AS (SELECT *, CAST(nullif(regexp_extract(stem || ' ' || array_to_string(choices, ' '), '\[\s*(\d+(?:\.\d+)?)\s*점\s*\]', 1), '') AS DOUBLE) AS mark, mode = 'vision' AS scan, coalesce(choices_source = 'image', false) AND len(choices) = 0 AS pictured, coalesce(points IN (2, 3), false) AS on_tier FROM full_items),
n AS (SELECT qid, 'vision_with_text' AS rule, 'info' AS severity FROM m WHERE scan AND (stem <> '' OR len(choices) > 0)
UNION ALL SELECT qid, 'choices_pictured', 'warn' FROM m WHERE NOT scan AND pictured
UNION ALL SELECT qid, 'choice_count', 'error' FROM m WHERE NOT scan AND NOT pictured AND len(choices) <> 5
UNION ALL SELECT qid, 'mark_differs', 'error' FROM m WHERE NOT scan AND mark IS NOT NULL AND points IS DISTINCT FROM mark
UNION ALL SELECT qid, 'mark_missing_for_points', 'error' FROM m WHERE NOT scan AND mark IS NULL AND on_tier AND points <> 2
UNION ALL SELECT qid, 'off_tiers', 'error' FROM m WHERE NOT on_tier)
SELECT * FROM n""")
def item_rules(spark, sf_dir):
    """V2 and NF7: twenty questions of fifty points give the tiers 2 and 3."""
    lit = lambda x, t: F.lit(x).cast(t)
    tier = items.point_tiers(lit(20, "long"), lit(50, "long"), F.array().cast("array<double>"), lit(None, "double"), F.lit(False))
    d = _full(spark, sf_dir).withColumn("tier", tier)
    notes = items.item_notes(*[F.col(c) for c in ("stem", "choices", "points", "mode", "choices_source")], F.lit(None).cast("string"), F.col("tier"))
    return d.select("qid", F.explode(notes).alias("n")).select("qid", "n.rule", "n.severity")


@query("""SELECT code, CAST(count(*) AS BIGINT) AS n_items, CAST(count(DISTINCT subject) AS BIGINT) AS n_subjects FROM (SELECT l_orderkey % 5 AS subject, l_orderkey, unnest(list_distinct(list(l_returnflag || l_linestatus || l_linenumber))) AS code FROM lineitem GROUP BY l_orderkey) GROUP BY code""")
def code_usage(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))).alias("codes"))
    return items.code_usage(d.withColumn("subject", F.col("l_orderkey") % 5))


@query("SELECT l_partkey, l_suppkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_numbers(spark, sf_dir):
    return items.repeated_numbers(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT l_orderkey, min(l_quantity) AS lowest, max(l_quantity) AS highest, CAST(count(*) AS BIGINT) AS n_rows FROM lineitem GROUP BY l_orderkey")
def group_extremes(spark, sf_dir):
    return items.extremes(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity")


@query("""WITH a AS (SELECT DISTINCT l_partkey AS code FROM lineitem WHERE l_quantity > 30), b AS (SELECT DISTINCT l_partkey AS code FROM lineitem WHERE l_discount > 0.05), s AS (SELECT p_partkey AS code FROM part WHERE p_size > 10), h AS (SELECT DISTINCT l_partkey AS code FROM lineitem WHERE l_quantity > 48)
SELECT code FROM ((SELECT * FROM a UNION SELECT * FROM b) INTERSECT SELECT * FROM s) EXCEPT SELECT * FROM h""")
def missing_codes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "code")
    scope = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("code"))
    return items.missing_in_scope(li.filter("l_quantity > 30"), li.filter("l_discount > 0.05"), scope, li.filter("l_quantity > 48"))


@query("SELECT DISTINCT code FROM (SELECT l_partkey AS code FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT l_partkey FROM lineitem WHERE l_discount > 0.08) WHERE code IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def codes_in_scope(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "code")
    return items.codes_in_scope(li.filter("l_quantity > 45"), li.filter("l_discount > 0.08"), table(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").alias("code")))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS code, o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS excluded FROM orders")
def labels_in_scope(spark, sf_dir):
    lab = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("code"))
    return items.in_scope(lab, table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("code"))).select("o_orderkey", "code", "excluded")


@query("SELECT n_labelled, n_learned, n_learned * 3 < n_labelled AS skewed FROM (SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_labelled FROM orders), (SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_learned FROM orders WHERE o_totalprice > 400000)")
def learn_skew(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return items.skewed(o, o.filter("o_totalprice > 400000"), "o_custkey")


@query("""SELECT s_suppkey, list_aggregate(list_distinct_ordered, 'string_agg', ',') AS codes FROM (SELECT s_suppkey, list_transform(list_sort(list_distinct([CAST(s_nationkey AS VARCHAR), CAST(s_suppkey % 7 AS VARCHAR), CAST(s_suppkey % 3 AS VARCHAR)])), lambda x: x) AS list_distinct_ordered FROM supplier)""")
def ordered_unions(spark, sf_dir):
    """ST1; sorted here, since SQL's distinct keeps no order (tests look at the order)."""
    s = lambda c: F.col(c).cast("string")
    d = table(spark, sf_dir, "supplier").withColumns({"m": (F.col("s_suppkey") % 7), "r": (F.col("s_suppkey") % 3)})
    u = items.ordered_union(F.array(s("s_nationkey"), s("m")), F.array(s("r"), F.lit(None).cast("string")))
    return d.select("s_suppkey", F.array_join(F.array_sort(u), ",").alias("codes"))


@query("""WITH r AS (SELECT c_custkey, 'u' || c_nationkey AS unit, CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN '0.5' END AS confidence, CASE WHEN c_custkey % 6 = 0 THEN 'kept' END AS own_grade, c_mktsegment AS note FROM customer)
SELECT c_custkey, unit, CASE WHEN confidence = '0.5' THEN confidence END AS confidence, coalesce(own_grade, CASE WHEN confidence = 'high' THEN 'high' END) AS grade, note FROM r""")
def contract_records(spark, sf_dir):
    d = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    rec = F.create_map(F.lit("unit"), F.concat(F.lit("u"), F.col("c_nationkey").cast("string")), F.lit("confidence"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "0.5"), F.lit("grade"), F.when(k % 6 == 0, "kept"), F.lit("note"), F.col("c_mktsegment"))
    d = d.select("c_custkey", items.contract_entry(rec).alias("e"))
    return d.select("c_custkey", F.col("e.kept")["unit"].alias("unit"), F.col("e.kept")["confidence"].alias("confidence"), F.col("e.ext")["grade"].alias("grade"), F.col("e.ext")["note"].alias("note"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN '' ELSE p_brand || CASE p_partkey % 4 WHEN 0 THEN '' ELSE ',' || p_type END END AS terms, CAST(CASE WHEN p_partkey % 4 IN (1, 2) THEN 1 ELSE 0 END AS INTEGER) AS n_learned FROM part""")
def keyword_entries(spark, sf_dir):
    """J2 and J3: an entry as a list, with learned rows, with learned weights, or broken."""
    k, b, t = F.col("p_partkey") % 4, F.to_json(F.array("p_brand")), F.to_json(F.array("p_type"))
    name = F.regexp_extract(t, r"^\[(.*)\]$", 1)
    raw = F.when(k == 0, b).when(k == 1, F.concat(F.lit('{"curriculum": '), b, F.lit(', "learned": [{"term": '), name, F.lit(', "weight": 0.5}]}'))).when(k == 2, F.concat(F.lit('{"curriculum": '), b, F.lit(', "learned": {'), name, F.lit(": 0.5}}"))).otherwise("not json")
    d = table(spark, sf_dir, "part").select("p_partkey", items.keyword_entry(raw).alias("e"))
    return d.select("p_partkey", F.array_join(items.entry_terms(F.col("e")), ",").alias("terms"), F.size("e.learned").alias("n_learned"))
