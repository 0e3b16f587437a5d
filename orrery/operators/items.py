"""Items: selection, fields, checks against marks and tiers, label sets, contract records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.exams import mark_points, same_points

#: Keys that a classification record keeps; all others go under `ext`.
# The contract's keys.
CONTRACT_KEYS = ["standard", "unit", "by", "confidence"]
CHOICES = 5


def selected(items: DataFrame, tokens: DataFrame, qid: str = "qid", exam: str = "exam", token: str = "token") -> DataFrame:
    """Items whose own key or whose exam is a token (PF1): two semi joins, so the token table may be of any size."""
    own = items.join(tokens.select(F.col(token).alias(qid)), qid, "left_semi")
    rest = items.join(tokens.select(F.col(token).alias(qid)), qid, "left_anti")
    return own.select(items.columns).unionByName(rest.join(tokens.select(F.col(token).alias(exam)), exam, "left_semi").select(items.columns))


def wanted_exams(items: DataFrame, tokens: DataFrame, qid: str = "qid", exam: str = "exam", token: str = "token") -> DataFrame:
    """Exams that a token names, by itself or by one of its items (PF2)."""
    return selected(items, tokens, qid, exam, token).select(exam).distinct()


def fields(stem: Column, boxed: Column, choices: Column, *solutions: Column) -> Column:
    """A map of the filled text fields; choices joined by ' / ', the first filled solution as explanation (PF4)."""
    fill = lambda c: F.when(c != "", c)
    parts = F.array(
        F.struct(F.lit("stem").alias("k"), fill(stem).alias("v")),
        F.struct(F.lit("boxed").alias("k"), fill(boxed).alias("v")),
        F.struct(F.lit("choices").alias("k"), F.when(F.size(choices) > 0, F.array_join(choices, " / ")).alias("v")),
        F.struct(F.lit("explanation").alias("k"), F.coalesce(*[fill(s) for s in solutions]).alias("v")),
    )
    return F.map_from_entries(F.filter(parts, lambda p: p["v"].isNotNull()))


def item_text(f: Column) -> Column:
    """The fields of an item in one text, in the order of their places (PF5)."""
    return F.array_join(F.filter(F.array(*[F.element_at(f, k) for k in ("stem", "boxed", "choices", "explanation")]), lambda x: x.isNotNull()), " ")


def public(df: DataFrame) -> DataFrame:
    """Without columns that begin with an underscore (PF12)."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def point_tiers(count: Column, total: Column, declared: Column, unmarked: Column, unmarked_declared: Column) -> Column:
    """(tiers, unmarked, known): declared tiers, or total div count and one more; null without either (NF7)."""
    base = F.floor(total / F.when(count != 0, count))
    solved = F.when((F.coalesce(count, F.lit(0)) != 0) & (F.coalesce(total, F.lit(0)) != 0), F.array(base.cast("double"), (base + 1).cast("double")))
    own = F.size(F.coalesce(declared, F.array().cast("array<double>"))) > 0
    tiers = F.when(own, declared.cast("array<double>")).otherwise(solved)
    plain = F.when(own | unmarked_declared, unmarked.cast("double")).otherwise(base.cast("double"))
    return F.when(tiers.isNotNull(), F.struct(tiers.alias("tiers"), plain.alias("unmarked"), F.when(own, unmarked_declared).otherwise(F.lit(True)).alias("known")))


def item_notes(stem: Column, choices: Column, points: Column, mode: Column, choices_source: Column, raw: Column, tier: Column) -> Column:
    """An array of (rule, severity) that an item breaks (V2).

    The mark is looked for in the stem, then in the choices, then in the raw
    text. Scanned items are excused from text; pictured choices only warn.
    """
    stem, raw = F.coalesce(stem, F.lit("")), F.coalesce(raw, F.lit(""))
    choices = F.coalesce(choices, F.array().cast("array<string>"))
    scan = F.coalesce(mode == "vision", F.lit(False))
    pictured = F.coalesce(choices_source == "image", F.lit(False)) & (F.size(choices) == 0)
    mark = F.coalesce(mark_points(F.concat_ws(" ", stem, F.array_join(choices, " "))), mark_points(raw))
    on_tier = F.exists(tier["tiers"], lambda t: same_points(points, t))
    off = lambda a, b: ~same_points(a, b)
    bare = ~scan & mark.isNull() & F.coalesce(on_tier, F.lit(False))
    rules = [
        ("vision_with_text", "info", scan & ((stem != "") | (F.size(choices) > 0))),
        ("choices_pictured", "warn", ~scan & pictured),
        ("choice_count", "error", ~scan & ~pictured & (F.size(choices) != CHOICES)),
        ("mark_differs", "error", ~scan & mark.isNotNull() & off(points, mark)),
        ("unmarked_unknown", "warn", bare & ~tier["known"]),
        ("mark_missing", "error", bare & tier["known"] & tier["unmarked"].isNull()),
        ("mark_missing_for_points", "error", bare & tier["known"] & tier["unmarked"].isNotNull() & off(points, tier["unmarked"])),
        ("off_tiers", "error", tier.isNotNull() & ~F.coalesce(on_tier, F.lit(False))),
    ]
    broken = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, c in rules])
    return F.filter(broken, lambda x: x.isNotNull())


def contract_entry(entry: Column) -> Column:
    """(kept, ext) maps of a record of strings: contract keys stay, others go to ext; a confidence that is no number becomes ext's grade (PF16)."""
    known = F.array(*[F.lit(k) for k in CONTRACT_KEYS])
    word = entry["confidence"].isNotNull() & ~entry["confidence"].rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    kept = F.map_filter(entry, lambda k, v: F.array_contains(known, k))
    kept = F.transform_values(kept, lambda k, v: F.when((k == "confidence") & F.coalesce(word, F.lit(False)), F.lit(None).cast("string")).otherwise(v))
    ext = F.map_filter(entry, lambda k, v: ~F.array_contains(known, k))
    grade = F.when(F.coalesce(word, F.lit(False)) & entry["grade"].isNull(), F.create_map(F.lit("grade"), entry["confidence"])).otherwise(F.create_map().cast("map<string,string>"))
    return F.struct(kept.alias("kept"), F.map_concat(F.map_filter(ext, lambda k, v: ~(F.coalesce(word, F.lit(False)) & (k == "grade") & v.isNull())), grade).alias("ext"))


def ordered_union(*arrays: Column) -> Column:
    """Distinct values of arrays in order of first place, nulls out (ST1)."""
    return F.array_distinct(F.array_compact(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])))


def missing_in_scope(left: DataFrame, right: DataFrame, scope: DataFrame, have: DataFrame, code: str = "code") -> DataFrame:
    """(left or right) and scope, but not have (ST3)."""
    return left.select(code).union(right.select(code)).intersect(scope.select(code)).exceptAll(have.select(code).distinct())


def codes_in_scope(book: DataFrame, catalog: DataFrame, scope: DataFrame, code: str = "code") -> DataFrame:
    """Codes of a book or a catalog that are in scope (ST4)."""
    return book.select(code).union(catalog.select(code)).distinct().join(scope.select(code).distinct(), code, "left_semi")


def code_usage(items: DataFrame, codes: str = "codes", subject: str = "subject") -> DataFrame:
    """code, n_items, n_subjects of multi-valued codes (AG20)."""
    return items.select(subject, F.explode(F.array_distinct(codes)).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct(subject).alias("n_subjects"))


def repeated_numbers(df: DataFrame, *place: str) -> DataFrame:
    """Places that hold a number more than once, and how often (AG26)."""
    return df.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def extremes(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, lowest, highest, rows (AG34)."""
    return df.groupBy(group).agg(F.min(value).alias("lowest"), F.max(value).alias("highest"), F.count(F.lit(1)).alias("n_rows"))


def skewed(labelled: DataFrame, learned: DataFrame, code: str = "code", factor: int = 3) -> DataFrame:
    """n_labelled, n_learned, skewed: fewer than a third of the labelled codes have learned terms (V11)."""
    a, b = labelled.agg(F.count_distinct(code).alias("n_labelled")), learned.agg(F.count_distinct(code).alias("n_learned"))
    return a.join(b).withColumn("skewed", F.col("n_learned") * factor < F.col("n_labelled"))  # a row by a row


def in_scope(labels: DataFrame, catalog: DataFrame, code: str = "code") -> DataFrame:
    """Labels with `excluded`: true where the catalog lacks the code (V12)."""
    known = catalog.select(code).distinct().withColumn("_known", F.lit(True))
    return labels.join(known, code, "left").withColumn("excluded", F.col("_known").isNull()).drop("_known")


def keyword_entry(raw: Column) -> Column:
    """(curriculum, learned) of a keyword entry in any shape (J2): a list is curriculum; of a record both, learned as {term: weight} or a list of rows."""
    v = F.try_parse_json(raw)
    get = lambda p, t: F.try_variant_get(v, p, t)
    plain = get("$", "array<string>")
    rows = get("$.learned", "array<struct<term: string, weight: double>>")
    weights = get("$.learned", "map<string, double>")
    none = F.array().cast("array<struct<term: string, weight: double>>")
    from_map = F.transform(F.array_sort(F.map_keys(weights)), lambda k: F.struct(k.alias("term"), F.element_at(weights, k).alias("weight")))
    learned = F.filter(F.coalesce(rows, from_map, none), lambda r: r["term"].isNotNull())
    curriculum = F.coalesce(plain, get("$.curriculum", "array<string>"), F.array().cast("array<string>"))
    return F.struct(curriculum.alias("curriculum"), learned.alias("learned"))


def entry_terms(entry: Column) -> Column:
    """Curriculum terms, then learned ones, each once (J3)."""
    return F.array_distinct(F.concat(entry["curriculum"], F.transform(entry["learned"], lambda r: r["term"])))
