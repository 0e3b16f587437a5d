"""Exam papers as text: what kind of paper it is, and the tables it carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orrery.functions import exams
from orrery.functions import text as ft

# Headings of solution and answer papers, and the limits of each kind.
SOLUTION_HEADING = r"정답\s*(?:및|과)\s*해설|해설\s*(?:및|과)\s*정답|오답\s*(?:풀이|피하기)|정답\s*해설|출제\s*의도|\[\s*해\s*설\s*\]"
ANSWER_HEADING = r"정\s*답\s*표|문\s*항\s*\n?\s*번\s*호|\(\s*[^)\n]{1,30}?\s*\)\s*과목"
PROBLEM_RUNS, SOLUTION_MARKS, ANSWER_MARKS, ANSWER_PAGE_CHARS = 10, 3, 2, 600
ANSWER_RUNS, SOLUTION_RUNS = 2, 5
USABLE_CHARS, USABLE_HANGUL, PAGE_CHARS, PAGE_HANGUL = 500, 0.40, 40, 0.30


def content_kind(df: DataFrame, pages: str = "pages") -> DataFrame:
    """Add runs, solution_marks, answer_marks, page_chars and kind.

    `kind` is problem, solution or answer if exactly one of the three shows,
    else null. Null or blank pages give null.
    """
    whole = F.array_join(F.coalesce(F.col(pages), F.array()), "")
    d = df.withColumn("_t", whole).withColumns({
        "runs": ft.choice_runs(F.col("_t")).cast("int"),
        "solution_marks": F.regexp_count("_t", F.lit(SOLUTION_HEADING)),
        "answer_marks": F.regexp_count("_t", F.lit(ANSWER_HEADING)),
        "page_chars": F.floor(F.length("_t") / F.greatest(F.size(F.coalesce(F.col(pages), F.array())), F.lit(1))).cast("int"),
    })
    answer = (F.col("answer_marks") >= ANSWER_MARKS) & (F.col("solution_marks") == 0) & (F.col("runs") <= ANSWER_RUNS) & (F.col("page_chars") <= ANSWER_PAGE_CHARS)
    solution = (F.col("solution_marks") >= SOLUTION_MARKS) & (F.col("runs") <= SOLUTION_RUNS)
    problem = (F.col("runs") >= PROBLEM_RUNS) & (F.col("answer_marks") < ANSWER_MARKS) & (F.col("solution_marks") < SOLUTION_MARKS)
    votes = F.array_compact(F.array(F.when(answer, "answer"), F.when(solution, "solution"), F.when(problem, "problem")))
    blank = ~F.col("_t").rlike(r"\S")
    return d.withColumn("kind", F.when(~blank & (F.size(votes) == 1), votes[0])).drop("_t")


def settled_kind(named: Column, found: Column) -> tuple[Column, Column]:
    """The kind and its ground: contents win over the name, the name over nothing."""
    by = F.when(found.isNull(), F.when(named.isNotNull(), "name")).when(named.isNull(), "content").when(named == found, "name").otherwise("content over name")
    return F.coalesce(found, named), by


def layer_state(text: Column, pages: Column) -> Column:
    """empty, garbled or ok: whether a text layer can be parsed."""
    solid = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S"))
    return F.when(solid / F.greatest(F.coalesce(pages, F.lit(0)), F.lit(1)) < PAGE_CHARS, "empty").when(ft.hangul_ratio(F.coalesce(text, F.lit(""))) < PAGE_HANGUL, "garbled").otherwise("ok")


def layer_usable(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) >= USABLE_CHARS) & (ft.hangul_ratio(t) >= USABLE_HANGUL)


def chosen_layer(direct: Column, read: Column) -> tuple[Column, Column]:
    """Text and mode: the direct layer if usable, else what was read by sight, if any."""
    seen = F.coalesce(read, F.lit("")) != ""
    return F.when(layer_usable(direct), direct).when(seen, read), F.when(layer_usable(direct), "direct").when(seen, "ocr")


def inline_answers(df: DataFrame, key: str, text: str, count: int) -> DataFrame:
    """key, number, answer of tables like `01. 4  02. 5`, on one line each.

    The first answer of a number counts; a number without a right answer has 0.
    """
    found = lambda p, g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    plain, void = r"(?<!\d)(0[1-9]|[1-9][0-9])[ \t]*\.[ \t]*([1-5])(?!\d)", r"(?<!\d)(0[1-9]|[1-9][0-9])[ \t]*\.[ \t]*(없음|전항[ \t]*정답)"
    pairs = lambda p, a: F.arrays_zip(found(p, 1).alias("n"), a.alias("a"))
    given, none = pairs(plain, found(plain, 2)), pairs(void, F.transform(found(void, 2), lambda _: F.lit("0")))
    d = df.select(key, F.posexplode(F.concat(none, given)).alias("pos", "x")).select(key, "pos", F.col("x.n").cast("int").alias("number"), F.col("x.a").cast("int").alias("answer"))
    return d.filter(F.col("number").between(1, count)).groupBy(key, "number").agg(F.min_by("answer", "pos").alias("answer"))


def _ratio(cell: Column) -> Column:
    v = ft.number(F.rtrim(F.trim(cell), F.lit("%")))
    return F.when(v.between(0, 100), v)


def rate_rows(df: DataFrame, key: str, html: str, count: int) -> DataFrame:
    """key, number, rank, error_rate, points, answer, choices of rate tables in HTML.

    Rows under ten cells are another layout and go. The five shares are found
    by their sum near 100 and proved by the answer's own share, which must be
    100 less the error rate; unproved ones are null. The first row of a number
    counts.
    """
    inner = lambda t, tag: F.regexp_extract_all(t, F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    cells = lambda row: F.transform(inner(row, "td"), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " ")))
    whole = lambda c: (F.size(c) >= 10) & F.get(c, F.lit(0)).rlike(r"^\d{1,3}$") & F.get(c, F.lit(1)).rlike(r"^\d{1,3}$")
    read = lambda c: F.when(whole(c), F.struct(F.get(c, F.lit(1)).cast("int").alias("number"), F.get(c, F.lit(0)).cast("int").alias("rank"), c.alias("c"), F.transform(c, _ratio).alias("r")))
    # filters come after the explosion, so that none is pushed below the cells and takes a row apart again
    rows = F.transform(inner(F.col(html), "tr"), lambda row: ft.let(cells(row), read))
    d = df.select(key, F.posexplode(rows).alias("pos", "x")).filter("x IS NOT NULL").select(key, "pos", "x.*").withColumn("error_rate", F.get("r", F.lit(2)))
    d = d.filter(F.col("number").between(1, count) & F.col("error_rate").isNotNull())
    mark, symbol = ft.number(F.get("c", F.lit(3))), ft.choice_number(F.get("c", F.lit(4)))
    d = d.withColumns({"points": F.when((mark > 0) & (mark <= 10), mark), "answer": F.when(symbol.between(1, 5), symbol).cast("int")})
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    windows = F.transform(F.sequence(F.lit(6), F.size("r") - 4), lambda i: F.slice("r", i, 5))
    proved = F.filter(windows, lambda w: total(w).between(95, 105) & (F.abs(F.element_at(w, F.coalesce(F.col("answer"), F.lit(1))) - (100 - F.col("error_rate"))) <= 0.2) & F.col("answer").isNotNull())
    d = d.withColumn("choices", F.get(proved, F.lit(0)))
    names = ["rank", "error_rate", "points", "answer", "choices"]
    return d.groupBy(key, "number").agg(F.min_by(F.struct(*names), "pos").alias("x")).select(key, "number", "x.*")


def points_by_marks(df: DataFrame, key: str, number: str, mark: str, total: str) -> DataFrame:
    """key, number, points, reason: marked points, the unmarked ones solved from the total.

    One row per question, `total` alike within a key. Refused, with a reason
    and null points: all marked but the sum differs; several kinds of marks
    beside unmarked ones; nothing left; a base off the half-point grid; a base
    equal to the mark.
    """
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(mark).alias("m"), F.coalesce(F.sum(mark), F.lit(0.0)).alias("s"), F.count_distinct(mark).alias("kinds"), F.max(mark).alias("tier"), F.max(total).alias("t"))
    base = (F.col("t") - F.col("s")) / F.nullif(F.col("n") - F.col("m"), F.lit(0))
    g = g.withColumn("base", base).withColumn("reason", F.when(F.col("t").isNull(), "no total").when(F.col("m") == F.col("n"), F.when(~exams.same_points(F.col("s"), F.col("t")), "sum differs")).when(F.col("kinds") > 1, "several tiers").when(F.col("t") <= F.col("s"), "nothing left").when(~exams.on_grid(F.col("base")), "off grid").when((F.col("kinds") == 1) & exams.same_points(F.col("base"), F.col("tier")), "base equals mark"))
    d = df.join(g.select(key, "base", "reason"), key)
    return d.select(key, number, F.when(F.col("reason").isNull(), F.coalesce(F.col(mark), F.col("base"))).alias("points"), "reason")


def page_order(df: DataFrame, keys: list[str], columns: int, width: str = "width") -> DataFrame:
    """keys, text: the texts of boxes x0, x1, y joined down each of `columns` columns."""
    col = F.least(F.floor((F.col("x0") + F.col("x1")) / 2 / F.col(width) * columns), F.lit(columns - 1))
    rows = F.array_sort(F.collect_list(F.struct(col.alias("c"), F.col("y"), F.col("x0"), F.col("text"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def overlaps(rows: DataFrame, boxes: DataFrame, page: list[str], slack: float = 2.0, height: float = 16.0) -> DataFrame:
    """row_id, box_id: boxes centred within a row's height and over half the narrower width of it.

    Both sides carry x0, y0, x1, y1. Joined on the page and bands of `height`,
    so a page's rows meet only the boxes near them.
    """
    band = lambda y: F.floor(y / height)
    r = rows.select(*page, "row_id", *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")]).withColumn("band", F.explode(F.sequence(band(F.col("ry0") - slack), band(F.col("ry1") + slack))))
    b = boxes.select(*page, "box_id", "x0", "x1", ((F.col("y0") + F.col("y1")) / 2).alias("cy")).withColumn("band", band(F.col("cy")))
    shared = F.least("rx1", "x1") - F.greatest("rx0", "x0")
    hit = F.col("cy").between(F.col("ry0") - slack, F.col("ry1") + slack) & (shared > 0.5 * F.least(F.col("rx1") - F.col("rx0"), F.col("x1") - F.col("x0")))
    return r.join(b, [*page, "band"]).filter(hit).select("row_id", "box_id")


def lone_donor(files: DataFrame, folder: str, role: str, subject: str) -> DataFrame:
    """Add `inherited`: the folder's only problem paper's subject, for its only orphan of a role."""
    orphan = F.col(subject).isNull() & (F.col(role) != "problem")
    given = F.when((F.col(role) == "problem") & F.col(subject).isNotNull(), F.col(subject))
    w, alike = W.partitionBy(folder), W.partitionBy(folder, role)
    one = (F.count(given).over(w) == 1) & (F.sum(orphan.cast("int")).over(alike) == 1)
    return files.withColumn("inherited", F.when(orphan & one, F.max(given).over(w)))
