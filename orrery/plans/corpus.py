"""Scoring, learning and calibration over documents, labels and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orrery.functions import text as ft
from orrery.operators import calibration, crosswalk, learning, scoring
from orrery.plans.registry import query, table

CODES, PER_CODE, THRESHOLD = 12, 15, 0.35


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, term: the most frequent long words of the benchmark passages dealt to a code."""
    b = table(spark, sf_dir, "benchmark")
    w = b.select(F.concat(F.lit("C"), F.lpad((F.col("item_id") % CODES).cast("string"), 2, "0")).alias("code"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")).filter(F.length("term") >= 7)
    c = w.groupBy("code", "term").agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("code").orderBy(F.col("n").desc(), "term")
    return c.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= PER_CODE).select("code", "term")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, pos: the first line weighs 1.5, the rest 0.8."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", 2).alias("_l"))
    parts = F.array(F.struct(F.get("_l", F.lit(0)).alias("text"), F.lit(1.5).alias("pos")), F.struct(F.get("_l", F.lit(1)).alias("text"), F.lit(0.8).alias("pos")))
    return d.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.text", "p.pos").filter("text IS NOT NULL")


_SQL_DICT = """
words AS (SELECT 'C' || lpad(CAST(item_id % 12 AS VARCHAR), 2, '0') AS code, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark),
dict AS (SELECT code, term FROM (
  SELECT code, term, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, term) AS r
  FROM words WHERE length(term) >= 7 GROUP BY code, term) WHERE r <= 15),
docs AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents),
dfs AS (SELECT d.term, CAST(count(o.doc_id) AS BIGINT) AS df FROM (SELECT DISTINCT term FROM dict) d
  LEFT JOIN docs o ON contains(o.t, d.term) OR contains(replace(o.t, ' ', ''), replace(d.term, ' ', '')) GROUP BY d.term),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
idfs AS (SELECT term, df, (ln((n + 1) / (df + 1)) + 1) / (ln(n + 1) + 1) AS idf FROM dfs, total),
raw AS (SELECT doc_id, strpos(text, chr(10)) AS nl, text FROM documents WHERE text IS NOT NULL),
parts AS (
  SELECT doc_id, CASE WHEN nl > 0 THEN substr(text, 1, nl - 1) ELSE text END AS text, 1.5 AS pos FROM raw
  UNION ALL SELECT doc_id, substr(text, nl + 1), 0.8 FROM raw WHERE nl > 0),
flat AS (SELECT doc_id, CAST(pos AS DOUBLE) AS pos, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM parts),
hits AS (SELECT f.doc_id, d.code, d.term, max(f.pos) AS pos FROM flat f JOIN dict d
  ON contains(f.t, d.term) OR contains(replace(f.t, ' ', ''), replace(d.term, ' ', '')) GROUP BY ALL),
ev AS (SELECT doc_id, code, least(sum(-ln(1 - least(0.97, idf * pos))), -ln(1e-12)) AS evidence, CAST(count(*) AS BIGINT) AS matched
  FROM hits JOIN idfs USING (term) GROUP BY ALL),
scored AS (SELECT doc_id, code, matched, floor(evidence / sum(evidence) OVER (PARTITION BY doc_id) * (1 - exp(-evidence)) * 10000 + 0.5) / 10000 AS score FROM ev),
ranks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) AS rank FROM scored)
"""


def _weights(spark: SparkSession, sf_dir: str, d: DataFrame) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scoring.idf(scoring.document_frequency(docs, d, "text"), docs.count())


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    w = _weights(spark, sf_dir, d).select("term", F.col("idf").alias("weight"))
    return scoring.scores(scoring.evidence(fields(spark, sf_dir), d, w, "doc_id"), "doc_id")


@query(f"WITH {_SQL_DICT} SELECT term, df FROM dfs")
def term_document_frequency(spark, sf_dir):
    return scoring.document_frequency(table(spark, sf_dir, "documents"), dictionary(spark, sf_dir), "text")


@query(f"WITH {_SQL_DICT} SELECT term, df, floor(idf * 10000 + 0.5) / 10000 AS idf FROM idfs")
def smoothed_idf(spark, sf_dir):
    return _weights(spark, sf_dir, dictionary(spark, sf_dir)).select("term", "df", ft.round4(F.col("idf")).alias("idf"))


@query(f"WITH {_SQL_DICT} SELECT doc_id, code, score, matched FROM scored")
def keyword_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("doc_id", "code", "score", "matched")


@query(f"WITH {_SQL_DICT} SELECT doc_id, CAST(rank AS INTEGER) AS rank, code, score, matched FROM ranks WHERE rank <= 3")
def ranked_top3(spark, sf_dir):
    return scoring.ranked(_scores(spark, sf_dir), "doc_id").select("doc_id", "rank", "code", "score", "matched")


@query(f"""WITH {_SQL_DICT}, top2 AS (
  SELECT o.doc_id, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b FROM docs o LEFT JOIN ranks r USING (doc_id) GROUP BY o.doc_id)
SELECT doc_id, coalesce(a, 0.0) AS top, coalesce(b, 0.0) AS second,
  concat_ws(',', CASE WHEN a IS NULL THEN 'no_match' END, CASE WHEN coalesce(a, 0) < 0.35 THEN 'low_top' END,
    CASE WHEN a IS NOT NULL AND floor((a - coalesce(b, 0)) * 10000 + 0.5) / 10000 < 0.15 THEN 'close_gap' END) AS reasons FROM top2""")
def queue_reasons(spark, sf_dir):
    return scoring.queue_reasons(table(spark, sf_dir, "documents"), _scores(spark, sf_dir), "doc_id", CODES, THRESHOLD)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("label"))
    return table(spark, sf_dir, "documents").join(lab, "doc_id")


_SQL_LEARN = """
toks AS (SELECT d.doc_id, 'q' || l.quality || 't' || l.toxic AS code,
  list_filter(regexp_extract_all(lower(coalesce(d.text, '')), '[가-힣A-Za-z0-9]+'), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+')) AS ws
  FROM documents d JOIN labels l USING (doc_id)),
sets AS (SELECT code, list_distinct(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS ts FROM toks WHERE len(ws) > 0),
per AS (SELECT code, CAST(count(*) AS BIGINT) AS n_c FROM sets GROUP BY code),
ab AS (SELECT code, term, CAST(count(*) AS BIGINT) AS a FROM (SELECT code, unnest(ts) AS term FROM sets) GROUP BY ALL),
dfs AS (SELECT term, CAST(sum(a) AS BIGINT) AS df FROM ab GROUP BY term),
cont AS (SELECT code, term, a, df, n_c, (SELECT CAST(sum(n_c) AS BIGINT) FROM per) AS n FROM ab JOIN dfs USING (term) JOIN per USING (code)),
lors AS (SELECT *, ln((a + 0.5) / (n_c - a + 0.5)) - ln((df - a + 0.5) / (n - n_c - (df - a) + 0.5)) AS lor FROM cont),
wts AS (SELECT *, floor(1 / (1 + exp(-lor)) * a / (a + 2) * 10000 + 0.5) / 10000 AS weight FROM lors),
gated AS (SELECT *, CASE WHEN a < 2 THEN 'rare' WHEN df > 0.4 * n THEN 'common' WHEN lor < 1 THEN 'low_lor' ELSE 'passed' END AS gate FROM wts),
passed AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY weight DESC, df DESC, term) AS r FROM gated WHERE gate = 'passed'),
kept AS (SELECT p.* FROM passed p WHERE NOT EXISTS (SELECT 1 FROM passed b WHERE b.code = p.code AND b.r < p.r AND contains(b.term, p.term)))
"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.gated(learning.log_odds(learning.contingency(_labelled(spark, sf_dir), "doc_id", "text", "label")))


@query(f"WITH {_SQL_LEARN} SELECT code, term, a, df, n_c, n, floor(lor * 1000 + 0.5) / 1000 AS lor, weight FROM wts")
def class_log_odds(spark, sf_dir):
    return learning.rounded(_gated(spark, sf_dir)).select("code", "term", "a", "df", "n_c", "n", "lor", "weight")


@query(f"WITH {_SQL_LEARN} SELECT * FROM (SELECT code, term, a, df, floor(lor * 1000 + 0.5) / 1000 AS lor, weight, CAST(row_number() OVER (PARTITION BY code ORDER BY weight DESC, df DESC, term) AS INTEGER) AS rank FROM kept) WHERE rank <= 15")
def learned_terms(spark, sf_dir):
    return learning.rounded(learning.learned(_gated(spark, sf_dir)))


@query(f"WITH {_SQL_LEARN} SELECT code, CAST(count(*) AS BIGINT) AS candidates, CAST(count(*) FILTER (gate = 'rare') AS BIGINT) AS rare, CAST(count(*) FILTER (gate = 'common') AS BIGINT) AS common, CAST(count(*) FILTER (gate = 'low_lor') AS BIGINT) AS low_lor, CAST(count(*) FILTER (gate = 'passed') AS BIGINT) AS passed FROM gated GROUP BY code")
def learn_funnel(spark, sf_dir):
    return learning.funnel(_gated(spark, sf_dir))


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hold-out: quality as gold, a length rule as prediction, a score from the word count."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("n_chars").cast("double")
    return d.select("doc_id", F.col("quality").alias("gold"), F.when(F.col("n_chars") >= 120, 1).otherwise(0).alias("pred"), F.when(F.col("toxic") == 0, F.col("lang")).alias("gold_unit"), F.col("lang").alias("pred_unit"), ft.round4(n / (n + 1000)).alias("score"))


_SQL_GRADED = """graded AS (SELECT doc_id, quality AS gold, CASE WHEN n_chars >= 120 THEN 1 ELSE 0 END AS pred, CASE WHEN toxic = 0 THEN lang END AS gold_unit, lang AS pred_unit,
  floor(CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + 1000) * 10000 + 0.5) / 10000 AS score FROM documents JOIN labels USING (doc_id))"""


def _wilson(k: str, n: str) -> str:
    p = f"({k} / CAST({n} AS DOUBLE))"
    return f"CASE WHEN {n} > 0 THEN floor(({p} + 3.8416 / (2 * {n}) - 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n}))) / (1 + 3.8416 / {n}) * 10000 + 0.5) / 10000 END"


_SQL_CURVE = f"""{_SQL_GRADED}, th AS (SELECT round(0.20 + 0.05 * i, 2) AS threshold FROM range(15) t(i)),
pts AS (SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(count(*) FILTER (score >= threshold) AS BIGINT) AS auto, CAST(count(*) FILTER (score >= threshold AND gold = pred) AS BIGINT) AS ok,
  CAST(count(*) FILTER (score >= threshold AND gold_unit IS NOT DISTINCT FROM pred_unit) AS BIGINT) AS uok, CAST(count(*) AS BIGINT) AS n FROM th, graded GROUP BY threshold),
curve AS (SELECT threshold, auto, floor(auto / CAST(n AS DOUBLE) * 10000 + 0.5) / 10000 AS auto_rate, floor(ok / CAST(nullif(auto, 0) AS DOUBLE) * 10000 + 0.5) / 10000 AS accuracy, {_wilson('ok', 'auto')} AS accuracy_lo95,
  floor(uok / CAST(nullif(auto, 0) AS DOUBLE) * 10000 + 0.5) / 10000 AS unit_accuracy, n - auto AS queued, n FROM pts)"""


@query(f"WITH {_SQL_CURVE} SELECT * FROM curve")
def calibration_curve(spark, sf_dir):
    return calibration.curve(_graded(spark, sf_dir))


@query(f"""WITH {_SQL_GRADED}, o AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (gold = pred) AS BIGINT) AS correct, CAST(count(*) FILTER (gold_unit = pred_unit) AS BIGINT) AS unit_correct FROM graded)
SELECT n, correct, unit_correct, floor(correct / CAST(n AS DOUBLE) * 10000 + 0.5) / 10000 AS accuracy, {_wilson('correct', 'n')} AS accuracy_lo95, floor(unit_correct / CAST(n AS DOUBLE) * 10000 + 0.5) / 10000 AS unit_accuracy FROM o""")
def calibration_overall(spark, sf_dir):
    return calibration.overall(_graded(spark, sf_dir))


@query(f"WITH {_SQL_CURVE} SELECT min(threshold) AS threshold FROM curve WHERE threshold >= 0.35 AND auto >= 10 AND accuracy >= 0.85 AND n >= 20")
def recommended_threshold(spark, sf_dir):
    return calibration.recommended(calibration.curve(_graded(spark, sf_dir)))


@query(f"WITH {_SQL_CURVE} SELECT g.doc_id, g.score, max(c.accuracy_lo95) AS confidence FROM graded g LEFT JOIN curve c ON c.threshold <= g.score AND c.threshold >= 0.35 AND c.auto >= 10 GROUP BY ALL")
def confidence_lookup(spark, sf_dir):
    g = _graded(spark, sf_dir)
    return calibration.confidence(g.select("doc_id", "score"), calibration.curve(g))


@query("SELECT quality, toxic, CAST(count(*) AS BIGINT) AS n, floor(count(*) / CAST((SELECT count(*) FROM labels) AS DOUBLE) * 10000 + 0.5) / 10000 AS share FROM labels GROUP BY ALL")
def label_mix(spark, sf_dir):
    c = table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", ft.round4(F.col("n") / F.sum("n").over(W.partitionBy())))


@query("""SELECT doc_id, coalesce(a, b) AS label, CASE WHEN a IS NOT NULL THEN 'items' ELSE 'mapping' END AS origin FROM
  (SELECT doc_id, CASE WHEN n_chars > 1000 THEN lang END AS a FROM documents) i FULL JOIN (SELECT doc_id, 'q' || quality AS b FROM labels) m USING (doc_id) WHERE coalesce(a, b) IS NOT NULL""")
def gold_labels(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, F.col("lang")).alias("label"))
    mapping = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("label"))
    return crosswalk.gold(items, mapping, "doc_id", "label")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def holdout_anti_join(spark, sf_dir):
    return crosswalk.without(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


_SQL_MAP = """it AS (SELECT doc_id, lang, source, CASE WHEN n_chars % 3 = 0 THEN 'manual' WHEN n_chars % 3 = 1 THEN 'llm' END AS "by" FROM documents),
mp AS (SELECT doc_id + 7 AS doc_id, CASE WHEN toxic = 1 THEN 'xx' ELSE 'en' END AS lang, 'src' || (doc_id + 7) % 20 AS source FROM labels)"""


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.when(F.col("n_chars") % 3 == 0, "manual").when(F.col("n_chars") % 3 == 1, "llm").alias("by"))
    mapping = table(spark, sf_dir, "labels").select((F.col("doc_id") + 7).alias("doc_id"), F.when(F.col("toxic") == 1, "xx").otherwise("en").alias("lang"), F.concat(F.lit("src"), ((F.col("doc_id") + 7) % 20).cast("string")).alias("source"))
    return items, mapping


@query(f"""WITH {_SQL_MAP} SELECT m.doc_id, CASE WHEN i.doc_id IS NULL THEN 'missing' WHEN m.lang IS NOT DISTINCT FROM i.lang AND m.source IS NOT DISTINCT FROM i.source THEN 'unchanged'
  WHEN i."by" = 'manual' THEN 'conflict' ELSE 'applied' END AS outcome, m.lang, m.source FROM mp m LEFT JOIN it i USING (doc_id)""")
def crosswalk_apply(spark, sf_dir):
    items, mapping = _mapped(spark, sf_dir)
    return crosswalk.apply(items, mapping, "doc_id", ["lang", "source"])


@query(f"""WITH {_SQL_MAP} SELECT doc_id, lang FROM it WHERE "by" IS NULL""")
def protection_gate(spark, sf_dir):
    return crosswalk.writable(_mapped(spark, sf_dir)[0]).select("doc_id", "lang")


@query("""SELECT coalesce(d.doc_id, l.k) AS doc_id, CASE WHEN l.k IS NOT NULL THEN 'q' || l.quality ELSE d.lang END AS lang, d.source FROM documents d FULL JOIN (SELECT doc_id * 2 AS k, quality FROM labels) l ON d.doc_id = l.k""")
def set_preserve_merge(spark, sf_dir):
    new = table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("doc_id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"))
    return crosswalk.preserve_merge(table(spark, sf_dir, "documents"), new, "doc_id", ["lang"], ["source"])


@query("""WITH s AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[가-힣A-Za-z0-9]+'), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+')) AS ws FROM documents)
SELECT doc_id, CAST(i AS BIGINT) AS pos, ws[i] || ' ' || ws[i + 1] AS bigram FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM s)""")
def adjacent_bigrams(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", ft.bigrams(ft.tokens(F.coalesce("text", F.lit("")))).alias("b"))
    return d.select("doc_id", F.posexplode("b").alias("p", "bigram")).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "bigram")


@query("""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
n AS (SELECT source, count(DISTINCT doc_id) AS n FROM l GROUP BY source)
SELECT source, line, CAST(count(DISTINCT doc_id) AS BIGINT) AS pages FROM l JOIN n USING (source) GROUP BY source, line, n HAVING count(DISTINCT doc_id) >= greatest(3, 0.05 * n)""")
def repeated_line_chrome(spark, sf_dir):
    from orrery.operators import sequences

    lines = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return sequences.repeated_lines(lines, "source", "doc_id", "line", 3, 0.05)


@query("""SELECT doc_id, CASE WHEN length(t) <= 0 THEN '' ELSE t END AS excerpt FROM (
  SELECT doc_id, CASE WHEN length(a) > 400 THEN substr(a, 1, 400) WHEN length(b) <= 400 - length(a) THEN a || b WHEN 400 - length(a) > 10 THEN a || substr(b, 1, 400 - length(a)) ELSE a END AS t FROM (
    SELECT doc_id, CASE WHEN nl > 0 THEN substr(text, 1, nl - 1) ELSE text END AS a, CASE WHEN nl > 0 THEN substr(text, nl + 1) ELSE '' END AS b FROM (SELECT doc_id, coalesce(text, '') AS text, strpos(coalesce(text, ''), chr(10)) AS nl FROM documents)))""")
def budgeted_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ft.excerpt(F.split(F.coalesce("text", F.lit("")), "\n", 2), 400).alias("excerpt"))
