"""Votes, invariants, rules, catalogs, attention and ordered rows over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orrery.functions import text as ft
from orrery.operators import attention, catalog, sequences, voting
from orrery.plans.registry import query, table


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question, source, value: the latest event of a kind per user and day, its k modulo 3."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("question"), F.col("event_type").alias("source"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("value"), "event_id")
    return e.groupBy("question", "source").agg(F.max_by("value", "event_id").alias("value"))


_SQL_READ = """rd AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS question, event_type AS source, arg_max(CAST(json_extract_string(props, '$.k') AS INTEGER) % 3, event_id) AS value FROM events GROUP BY ALL),
cn AS (SELECT question, value, count(*) AS n FROM rd GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY n DESC, value) AS r FROM cn),
tp AS (SELECT question, max(n) FILTER (r = 1) AS n1, coalesce(max(n) FILTER (r = 2), 0) AS n2, max(value) FILTER (r = 1) AS v, CAST(sum(n) AS BIGINT) AS voters, count(*) AS kinds FROM rk GROUP BY question)"""


@query(f"""WITH {_SQL_READ}, st AS (SELECT *, CASE WHEN n2 = 0 THEN 'ok' WHEN n1 >= 2 AND n1 > n2 THEN 'warn' ELSE 'error' END AS state FROM tp)
SELECT question, CASE WHEN state <> 'error' THEN v END AS verdict, state, voters FROM st""")
def majority_vote(spark, sf_dir):
    return voting.majority(readings(spark, sf_dir), ["question"])


@query(f"""WITH {_SQL_READ} SELECT question, CASE WHEN voters < 2 THEN 'abstain' WHEN kinds = 1 THEN 'ok' WHEN n1 >= 2 THEN 'warn' ELSE 'error' END AS state, voters FROM tp""")
def validator_vote(spark, sf_dir):
    r = readings(spark, sf_dir)
    own = F.col("source") == "click"
    return voting.validator(r.filter(~own), r.filter(own), ["question"])


@query("""SELECT user_id, CAST(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS BIGINT) AS checked, CAST(count(*) FILTER (a <> b) AS BIGINT) AS mismatches,
  count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) >= 5 AND count(*) FILTER (a <> b) = 0 AS passed
  FROM (SELECT user_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 END AS a, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 AS b FROM events) GROUP BY user_id""")
def cross_check_gate(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int") % 2
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "error", k).alias("a"), k.alias("b"))
    return voting.gate(e, "user_id", "a", "b")


@query("""SELECT o_orderkey, CAST(n AS BIGINT) AS n, total, CAST(want_n AS BIGINT) AS want_n, want_total, n = want_n AS n_ok, abs(total - want_total) <= 1e-6 AS total_ok FROM (
  SELECT o.o_orderkey, coalesce(l.n, 0) AS n, l.total, 4 AS want_n, CAST(o.o_custkey % 200 AS DOUBLE) AS want_total FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY ALL) l ON l_orderkey = o_orderkey)""")
def group_invariants(spark, sf_dir):
    want = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(4).cast("long").alias("want_n"), (F.col("o_custkey") % 200).cast("double").alias("want_total"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return attention.invariants(li, "o_orderkey", "l_quantity", want).select("o_orderkey", "n", "total", "want_n", "want_total", "n_ok", "total_ok")


# Inline rules of this query, first match wins.
RULES = [("URGENT", {}), ("^[1-3]-", {}), ("HIGH", {}), ("LOW$", {}), ("NEVER", {})]


@query("SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, 'URGENT') THEN 1 WHEN regexp_matches(o_orderpriority, '^[1-3]-') THEN 2 WHEN regexp_matches(o_orderpriority, 'HIGH') THEN 3 WHEN regexp_matches(o_orderpriority, 'LOW$') THEN 4 WHEN regexp_matches(o_orderpriority, 'NEVER') THEN 5 END AS rule FROM orders")
def rule_override_join(spark, sf_dir):
    return catalog.first_rule(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), RULES, "o_orderpriority").select("o_orderkey", "rule")


@query("SELECT rule, pattern, CAST(count(*) FILTER (regexp_matches(o_orderpriority, pattern)) AS BIGINT) AS matches FROM orders, (VALUES (1, 'URGENT'), (2, '^[1-3]-'), (3, 'HIGH'), (4, 'LOW$'), (5, 'NEVER')) r(rule, pattern) GROUP BY ALL")
def rule_coverage(spark, sf_dir):
    return catalog.rule_coverage(table(spark, sf_dir, "orders"), RULES, "o_orderpriority")


@query("""WITH c AS (SELECT DISTINCT p_brand || '-' || p_type AS code FROM part), p AS (SELECT DISTINCT substr(p_brand, 1, 7) AS prefix, p_type AS owner FROM part UNION SELECT DISTINCT p_brand, 'brand' FROM part),
m AS (SELECT code, max(length(prefix)) AS l FROM c JOIN p ON starts_with(code, prefix) GROUP BY code)
SELECT c.code, substr(c.code, 1, m.l) AS prefix, min(p.owner) AS owner, CAST(count(DISTINCT p.owner) AS BIGINT) AS n_owners FROM c LEFT JOIN m USING (code) LEFT JOIN p ON p.prefix = substr(c.code, 1, m.l) GROUP BY c.code, m.l""")
def longest_prefix_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    codes = p.select(F.concat_ws("-", "p_brand", "p_type").alias("code"))
    prefixes = p.select(F.substring("p_brand", 1, 7).alias("prefix"), F.col("p_type").alias("owner")).union(p.select("p_brand", F.lit("brand"))).distinct()
    return catalog.longest_prefix(codes, prefixes)


@query("""SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size > 49) THEN 'catalog' WHEN starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#2') THEN 'prefix' ELSE 'none' END AS basis FROM part""")
def scope_semi_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return catalog.in_scope(p.select("p_partkey", "p_brand"), p.filter("p_size > 49"), ["Brand#1", "Brand#2"], "p_brand").select("p_partkey", "basis")


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def coverage_gap(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return catalog.gaps(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), used, ["p_partkey"])


@query("SELECT p_brand AS code, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS owners FROM part GROUP BY p_brand")
def code_owners(spark, sf_dir):
    return catalog.code_owners(table(spark, sf_dir, "part"), "p_brand", "p_type").select(F.col("p_brand").alias("code"), F.array_join("owners", ",").alias("owners"))


@query("SELECT p_type, to_json(list({'p_brand': p_brand, 'leaves': leaves} ORDER BY p_brand))::VARCHAR AS nodes FROM (SELECT p_type, p_brand, list_sort(list(p_partkey)) AS leaves FROM part GROUP BY ALL) GROUP BY p_type")
def nested_tree(spark, sf_dir):
    return catalog.tree(table(spark, sf_dir, "part"), "p_type", "p_brand", "p_partkey").select("p_type", F.to_json("nodes").alias("nodes"))


@query("""SELECT r_name, coalesce(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END), 0)::BIGINT AS BUILDING, coalesce(sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 END), 0)::BIGINT AS MACHINERY, coalesce(sum(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 END), 0)::BIGINT AS AUTOMOBILE
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def pivot_sheet(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return catalog.sheet(c.withColumn("one", F.lit(1)), "r_name", "c_mktsegment", "one", ["BUILDING", "MACHINERY", "AUTOMOBILE"])


@query("SELECT r_name, string_agg('- ' || n_name, chr(10) ORDER BY n_name) AS body FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def markdown_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- "), "n_name"))), "\n").alias("body"))


_SQL_ATT = "att AS (SELECT event_id AS seq, event_type AS id, CASE WHEN event_type = 'error' THEN 'error' WHEN value > 50 THEN 'warn' ELSE 'info' END AS severity FROM events), ak AS (SELECT *, CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS k FROM att)"


def _attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("id"), F.when(F.col("event_type") == "error", "error").when(F.col("value") > 50, "warn").otherwise("info").alias("severity"))


@query(f"WITH {_SQL_ATT} SELECT seq, id, severity, greatest((SELECT count(*) FROM att) - 30, 0)::BIGINT AS truncated FROM ak ORDER BY k, seq LIMIT 30")
def attention_cap(spark, sf_dir):
    return attention.capped(_attention(spark, sf_dir))


@query(f"WITH {_SQL_ATT} SELECT seq, id, severity, greatest(n - 3, 0)::BIGINT AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, seq) AS r, count(*) OVER (PARTITION BY id) AS n FROM ak) WHERE r <= 3")
def step_top3(spark, sf_dir):
    return attention.capped(_attention(spark, sf_dir), 3, by=["id"]).select("seq", "id", "severity", "truncated")


@query("SELECT event_id, value, greatest((SELECT count(*) FROM events WHERE value >= 40) - 200, 0)::BIGINT AS overflow FROM events WHERE value >= 40 ORDER BY value DESC, event_id LIMIT 200")
def topk_with_overflow(spark, sf_dir):
    return attention.top_above(table(spark, sf_dir, "events").select("event_id", "value"), "value", 40.0, 200, "event_id")


@query("SELECT '_omitted' AS p_name, count(*)::VARCHAR AS p_brand FROM part HAVING count(*) > 120 UNION ALL SELECT p_name, p_brand FROM part WHERE (SELECT count(*) FROM part) <= 120")
def omitted_catalog(spark, sf_dir):
    return attention.or_omitted(table(spark, sf_dir, "part"), 120, ["p_name", "p_brand"])


@query("""SELECT l_orderkey, l_linenumber, why, severity FROM (
  SELECT l_orderkey, l_linenumber, 'tier' AS why, 'error' AS severity FROM lineitem WHERE l_quantity NOT BETWEEN 1 AND 45 UNION ALL
  SELECT l_orderkey, l_linenumber, 'discount', 'warn' FROM lineitem WHERE l_discount > 0.08 UNION ALL
  SELECT l_orderkey, l_linenumber, 'flag', 'info' FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F')""")
def item_checks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.struct("l_orderkey", "l_linenumber"))
    rules = [("tier", "error", ~F.col("l_quantity").between(1, 45)), ("discount", "warn", F.col("l_discount") > 0.08), ("flag", "info", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))]
    return attention.checks(li, "k", rules).select("k.l_orderkey", "k.l_linenumber", "why", "severity")


_C = "PARTITION BY conv_id ORDER BY turn"


@query(f"SELECT conv_id, turn, coalesce(last_value(s IGNORE NULLS) OVER ({_C} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(s IGNORE NULLS) OVER ({_C} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS speaker FROM (SELECT conv_id, turn, CASE WHEN role <> 'assistant' THEN role END AS s FROM conversations)")
def forward_fill(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("s", F.when(F.col("role") != "assistant", F.col("role")))
    return sequences.filled(c, ["conv_id"], "turn", "s", "speaker").select("conv_id", "turn", "speaker")


@query(f"SELECT conv_id, turn, lead(turn) OVER ({_C}) AS next_turn FROM conversations WHERE role = 'user'")
def section_bounds(spark, sf_dir):
    return sequences.sections(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user", "next_turn").select("conv_id", "turn", "next_turn")


@query(f"SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER ({_C}) AS BIGINT) AS block FROM conversations")
def next_block(spark, sf_dir):
    return sequences.groups(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user", "block").select("conv_id", "turn", "block")


@query("SELECT c.conv_id, c.turn, CAST(length(c.text) AS BIGINT) AS width FROM conversations c JOIN (SELECT conv_id, max(length(text)) AS m, count(*) AS n FROM conversations GROUP BY conv_id) g USING (conv_id) WHERE n >= 3 AND length(c.text) < 0.75 * m")
def narrow_outliers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("width"))
    return sequences.outliers(c, "conv_id", "width").select("conv_id", "turn", "width")


@query("""WITH RECURSIVE n AS (SELECT user_id, list(CAST(json_extract_string(props, '$.k') AS INTEGER) % 9 ORDER BY event_id) AS xs FROM events GROUP BY user_id),
s AS (SELECT user_id, xs, 1 AS i, 0 AS k FROM n UNION ALL SELECT user_id, xs, i + 1, CASE WHEN xs[i] = k + 1 THEN k + 1 ELSE k END FROM s WHERE i <= len(xs))
SELECT user_id, CAST(k AS INTEGER) AS accepted FROM s WHERE i = len(xs) + 1""")
def expected_sequence_scan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.struct("event_id", (F.get_json_object("props", "$.k").cast("int") % 9).alias("k")).alias("x"))
    xs = e.groupBy("user_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return xs.select("user_id", sequences.expected_sequence(F.transform("xs", lambda x: x["k"])).alias("accepted"))


@query("SELECT page_id, CAST(i AS BIGINT) AS pos, hrefs[i] AS href FROM (SELECT page_id, hrefs, unnest(range(1, len(hrefs) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1) AS hrefs FROM pages))")
def link_extraction(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1)).alias("h"))
    return p.select("page_id", F.posexplode("h").alias("p", "href")).select("page_id", (F.col("p") + 1).cast("long").alias("pos"), "href")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\\s\\x{00A0}]+', ' ', 'g')) AS body FROM pages")
def tag_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ft.strip_tags(F.col("html")).alias("body"))


@query("""WITH a AS (SELECT c_nationkey AS k, list_sort(list(DISTINCT c_mktsegment)) AS xs FROM customer GROUP BY ALL)
SELECT k, CAST(len(list_filter(['BUILDING', 'MACHINERY', 'NONE'], lambda x: NOT list_contains(xs, x))) AS INTEGER) AS missing, CAST(len(list_intersect(xs, ['BUILDING', 'AUTOMOBILE'])) AS INTEGER) AS shared, len(xs) = 5 AS complete FROM a""")
def array_set_ops(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.collect_set("c_mktsegment").alias("xs"))
    lits = lambda *v: F.array(*[F.lit(x) for x in v])
    return a.select("k", F.size(F.array_except(lits("BUILDING", "MACHINERY", "NONE"), F.col("xs"))).alias("missing"), F.size(F.array_intersect("xs", lits("BUILDING", "AUTOMOBILE"))).alias("shared"), (F.size("xs") == 5).alias("complete"))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e),
c AS (SELECT label AS class, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY ALL) GROUP BY label),
s AS (SELECT vec_id, class, floor(list_cosine_similarity(v, m) * 10000 + 0.5) / 10000 AS score FROM e, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) AS k FROM s)
SELECT vec_id, max(class) FILTER (k = 1) AS class, max(score) FILTER (k = 1) AS score, floor((max(score) FILTER (k = 1) - max(score) FILTER (k = 2)) * 10000 + 0.5) / 10000 AS margin FROM r GROUP BY vec_id""")
def nearest_class_margin(spark, sf_dir):
    """The class of the nearest mean by cosine, and the margin to the runner-up."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    m = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    means = m.groupBy(F.col("label").alias("class")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    one = means.agg(F.sort_array(F.collect_list(F.struct("class", "m"))).alias("cs"))  # a row; classes are few
    score = lambda c: ft.round4(dot(F.col("v"), c["m"]) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(c["m"], c["m"])))
    # sorted by (-score, class)
    s = e.crossJoin(F.broadcast(one)).select("vec_id", F.sort_array(F.transform("cs", lambda c: F.struct((-score(c)).alias("s"), c["class"].alias("class")))).alias("s"))
    a, b = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    return s.select("vec_id", a["class"].alias("class"), (-a["s"]).alias("score"), ft.round4(b["s"] - a["s"]).alias("margin"))
