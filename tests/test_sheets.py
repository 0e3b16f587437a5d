"""Answer sheet readers and question starts on small fixtures; starts against every rising choice."""

import itertools
import random
import re

from pyspark.sql import functions as F

from orrery.functions import files
from orrery.operators import layout, reconcile, sheets


def brute_starts(text, count):
    """Every rising choice, scored whole; the earliest among the best."""
    at = [[m.start() for m in re.finditer(sheets.START, text) if int(m[1]) == n] for n in range(1, count + 1)]
    best = None
    for chosen in itertools.product(*at):
        if any(a >= b for a, b in zip(chosen, chosen[1:])):
            continue
        total = 0
        for a, b in zip(chosen, [*chosen[1:], len(text)]):
            labels, want = [int(m) for line in text[a:b].splitlines() for m in re.findall(sheets.LABEL, line.strip())], 1
            for x in labels:
                want += x == want
            total += ("?" in text[a:b]) + (want > 5)
        if best is None or total > best[0]:
            best = total, list(chosen)
    return best and best[1]


def test_question_starts_equal_brute_force():
    r = random.Random(5)
    pieces = ["1. a", "2. b", "3. c", "why?", "1 x 2 y 3 z 4 u 5 v", "text", "1 2", "3 4 5"]
    for _ in range(400):
        text = "\n".join(r.choice(pieces) for _ in range(r.randint(0, 14)))
        assert sheets.question_starts(text, 3) == brute_starts(text, 3), text


def test_question_starts_give_up():
    assert sheets.question_starts("", 1) is None
    assert sheets.question_starts("2. b\n1. a", 2) is None
    assert sheets.question_starts("1. a\n" * 142, 1) == [0]  # 142 squared is above the budget: each number's first start in turn
    assert sheets.question_starts("1. a\n" * 141, 1) == [0]


def read(spark, reader, *sheets_, count=2):
    d = spark.createDataFrame(list(enumerate(sheets_)), "k int, t array<string>")
    got = [{} for _ in sheets_]
    for r in sheets.cells(d, "k", "t", count, reader).collect():
        got[r.k][r.number] = r.answer, r.points
    return got


def test_readers_without_a_whole_sheet(spark):
    assert read(spark, sheets.circled, [], None, ["1①", "2"], ["1①", "2", "없음"]) == [{}, {}, {}, {1: (1, None), 2: (0, None)}]
    two, three = {1: (1, None), 2: (1, None)}, {1: (1, 2)}
    assert read(spark, sheets.with_or_without_points, [], None, ["1", "①", "2", "1", "②"], ["1", "①", "2", "9"], ["1", "①", "2", "②"]) == [{}, {}, two, three, {1: (1, None), 2: (2, None)}]


def test_circled_chains(spark):
    glued, apart = ["1①", "2②", "3③"], ["1", "①", "2", "②", "3", "③"]
    whole = {1: (1, None), 2: (2, None), 3: (3, None)}
    stranger = ["1①", "88", "2②", "3③"]
    two = ["1①", "88", "2②", "89", "3③"]
    again = ["1⑤", "9", "9", *glued]  # the first chain breaks, the second is whole
    plain = ["1", "1", "2", "2", "3", "3"]  # bare digits are no circled answers
    assert read(spark, sheets.circled, glued, apart, stranger, two, again, plain, count=3) == [whole, whole, whole, {}, whole, {}]
    assert read(spark, lambda t, n: sheets.circled(t, n, skips=2), two, count=3) == [whole]
    assert read(spark, sheets.circled, ["x", "1③"], count=1) == [{1: (3, None)}]


def test_strides_take_no_overlapping_cells(spark):
    # 1-2 is taken first, so 2-3 inside it begins no cell; a number counts once
    assert read(spark, lambda t, n: sheets.strides(t, n, False), ["1", "2", "3", "4"], ["1", "2", "1", "3"], ["9", "1", "2"], count=3) == [{1: (2, None), 3: (4, None)}, {1: (2, None)}, {1: (2, None)}]


def test_columnar_blocks(spark):
    d = spark.createDataFrame([(1, "3\n1.\n2.\n4\n전항 정답\n5\n1.\n3.\n2\n1"), (2, None), (3, "")], "k int, t string")
    got = {tuple(r) for r in sheets.columnar(d, "k", "t", 9).collect()}
    assert got == {(1, 1, 4), (1, 2, 0), (1, 3, 1)}


def test_lines_under_the_latest_code(spark):
    d = spark.createDataFrame([(0, "A", "x"), (1, None, "one"), (2, None, "two"), (3, None, "•"), (4, None, "lost"), (5, "B", "y"), (6, None, "three")], "pos int, code string, text string").withColumn("doc", F.lit(1))
    got = layout.under_code(d.withColumnRenamed("code", "c"), "doc", "pos", F.col("c"), F.col("text") == "•", "text")
    assert {(r.code, r.body) for r in got.collect()} == {("A", "one two"), ("B", "three")}


def test_empty_tables_and_nulls(spark):
    boxes = spark.createDataFrame([], "page int, box int, x0 double, y0 double, x1 double, y1 double")
    assert layout.box_clusters(boxes, "page", "box", 1.0).count() == 0
    d = spark.createDataFrame([(None, None), ("a", [0.0, 0.5, 1.0, None])], "k string, b array<double>")
    assert [r[0] for r in d.select(files.unit_box(F.col("b"))).collect()] == [False, False]
    assert reconcile.with_reason(d, [("no key", F.col("k").isNotNull()), ("null", F.lit(None).cast("boolean"))]).select("reason").toPandas().reason.tolist() == ["no key", "null"]


def brute_paired(tokens, count):
    def answer(t):
        return 0 if t in sheets.NO_ANSWER else ("12345" + sheets.CIRCLED).index(t) % 5 + 1 if len(t) == 1 and t in "12345" + sheets.CIRCLED else None

    for s in range(len(tokens) - 2 * count + 1):
        if all(re.fullmatch(r"[0-9]+", tokens[s + 2 * i]) and int(tokens[s + 2 * i]) == i + 1 and answer(tokens[s + 2 * i + 1]) is not None for i in range(count)):
            return {i + 1: answer(tokens[s + 2 * i + 1]) for i in range(count)}
    return {}


def test_paired_equals_brute_force(spark):
    r = random.Random(3)
    rows = [[r.choice(["1", "2", "01", "①", "⑤", "없음", "x"]) for _ in range(r.randint(0, 12))] for _ in range(300)]
    d = spark.createDataFrame([*enumerate(rows), (300, None)], "k int, t array<string>")
    got = [{} for _ in range(301)]
    for x in sheets.paired(d, "k", "t", 2).collect():
        got[x.k][x.number] = x.answer
    assert got == [*[brute_paired(x, 2) for x in rows], {}] and sum(map(bool, got)) > 20


def test_paired_reads_a_sheet_once(spark):
    # a filter on a column made of the tokens would be pushed below them, and spell them out at each place that names them
    d = spark.createDataFrame([(1, "1\n①")], "k int, s string").select("k", sheets.sheet_tokens(F.col("s")).alias("t"))
    plan = sheets.paired(d, "k", "t", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_a_small_file_is_dealt_to_many_tasks(spark):
    from orrery.plans import registry

    part = registry.table(spark, "/root/testdata/sf0.001", "part").select("p_partkey")
    got = registry.dealt(part)
    assert got.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism and sorted(got.collect()) == sorted(part.collect())


def brute_columnar(text, count):
    """Line by line: blocks of numbers and answers, paired by place."""
    blocks, after = [([], [])], False
    for line in re.split(r"\r\n|[\n\x0b\f\r\x85  ]", text):
        line = line.strip()
        bare = re.sub(r"[ \t]", "", line)
        if m := re.fullmatch(r"(0?[1-9]|[1-9][0-9])\.", line):
            if after:
                blocks.append(([], []))
            blocks[-1][0].append(int(m[1]))
            after = False
        elif re.fullmatch("[1-5]", line) or bare in sheets.NO_ANSWER:
            blocks[-1][1].append(0 if bare in sheets.NO_ANSWER else int(line))
            after = True
    out = {}
    for numbers, answers in blocks:
        for n, a in zip(numbers, answers):
            if n <= count:
                out.setdefault(n, a)
    return out


def test_columnar_equals_brute_force(spark):
    r = random.Random(8)
    pieces = ["1.", "2.", " 03.", "12.\t", "4", "　" + "5 ", "전항 정답", "없\t음", "없　음", "6", "1. 2", "", "head 7", "1", "①", "10.", "0."]
    rows = ["".join(r.choice(pieces) + r.choice(["\n", "\n", "\r\n", "\f", " "]) for _ in range(r.randint(0, 14))) for _ in range(400)]
    d = spark.createDataFrame([*enumerate(rows)], "k int, t string")
    got = [{} for _ in rows]
    for x in sheets.columnar(d, "k", "t", 11).collect():
        assert x.number not in got[x.k]
        got[x.k][x.number] = x.answer
    assert got == [brute_columnar(x, 11) for x in rows] and sum(map(bool, got)) > 100


def test_columnar_keeps_a_sheet_in_its_task(spark):
    # windows over exploded lines sort every line of a task's sheets in memory
    d = spark.createDataFrame([(1, "1.\n2")], "k int, t string")
    plan = sheets.columnar(d, "k", "t", 9)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Window|Sort|Exchange", plan)


def test_circled_casts_numbers_only_and_uses_all_cores(spark):
    # each failing try_cast makes an exception with its message
    from orrery.plans import registry

    got = registry.queries()["circled_answers"](spark, "/root/testdata/sf0.001")
    assert "try_cast" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
