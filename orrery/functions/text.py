"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five circled digits that mark choices.
CIRCLED = "①②③④⑤"


def round4(x: Column) -> Column:
    """Half-up to four digits by one explicit formula, so that engines agree."""
    return F.floor(x * 10000 + 0.5) / 10000


def normalise_space(t: Column) -> Column:
    """Every white space, Unicode's too, collapses to one space; ends are trimmed."""
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def compact(t: Column) -> Column:
    return F.replace(t, F.lit(" "), F.lit(""))


def strip_tags(html: Column) -> Column:
    return normalise_space(F.regexp_replace(html, "<[^>]+>", " "))


def file_safe(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r'[\\/:*?"<>|]+', "_")


def hangul_ratio(t: Column) -> Column:
    """Share of Hangul syllables among non-space characters; 0 for blank text."""
    solid = F.regexp_count(t, F.lit(r"\S"))
    return F.when(solid > 0, F.regexp_count(t, F.lit("[가-힣]")) / solid).otherwise(F.lit(0.0))


def choice_runs(t: Column) -> Column:
    """Complete ordered cycles of the five choice symbols."""
    return F.regexp_count(F.regexp_replace(t, f"[^{CIRCLED}]", ""), F.lit(CIRCLED))


def choice_number(t: Column) -> Column:
    """1 to 5 from a circled or plain digit, 0 for anything else, null for null."""
    at = F.instr(F.lit(CIRCLED), F.trim(t))
    plain = F.when(F.trim(t).rlike("^[1-5]$"), F.trim(t).cast("int"))
    return F.when(t.isNull(), F.lit(None)).otherwise(F.coalesce(plain, F.when((F.length(F.trim(t)) == 1) & (at > 0), at), F.lit(0)))


def whole(t: Column) -> Column:
    """The string as an int, null if it is none; what cannot be one is not tried, since each failure of try_cast raises within."""
    return F.when(t.rlike(r"^[\x00-\x20\x7F]*[+-]?[0-9.]+[\x00-\x20\x7F]*$"), t.try_cast("int"))


def number(t: Column) -> Column:
    """The string as a finite double, null if it is none; what cannot be one is not tried, as in `whole`."""
    return F.when(t.rlike(r"^[\x00-\x20]*[+-]?[.0-9][0-9A-Za-z.+-]*[\x00-\x20]*$"), t.try_cast("double"))


def tokens(t: Column) -> Column:
    """Letters and digits of Latin and Hangul script, longer than one, not all digits."""
    run = "[가-힣A-Za-z0-9]"
    return F.regexp_extract_all(t, F.lit(f"(?<!{run})(?:[0-9]*+[가-힣A-Za-z]{run}++|[0-9]++[가-힣A-Za-z])"), F.lit(0))


def has_tokens(t: Column) -> Column:
    """Whether `tokens` gives any: a letter beside a letter or digit."""
    return t.rlike("[가-힣A-Za-z][가-힣A-Za-z0-9]|[0-9][가-힣A-Za-z]")


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pairs(ws: Column) -> Column:
    n = F.greatest(F.size(ws) - 1, F.lit(0))
    return F.zip_with(F.slice(ws, F.lit(1), n), F.slice(ws, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def bigrams(ws: Column) -> Column:
    """Adjacent pairs in order."""
    return let(ws, _pairs)


def terms(t: Column) -> Column:
    """The set of tokens and adjacent pairs."""
    return with_pairs(tokens(t))


def with_pairs(ws: Column) -> Column:
    """The set of words and adjacent pairs."""
    return let(ws, lambda x: F.array_union(x, _pairs(x)))


def excerpt(parts: Column, budget: int, least: int = 10) -> Column:
    """Chunks in order until the budget is used; the last is cut only if over `least` characters remain."""
    def step(acc: Column, p: Column) -> Column:
        room = F.lit(budget) - F.length(acc["text"])
        whole = F.length(p) <= room
        piece = F.when(whole, p).when(room > least, F.substring(p, F.lit(1), room)).otherwise(F.lit(""))
        text = F.when(acc["full"], acc["text"]).otherwise(F.concat(acc["text"], piece))
        return F.struct(text.alias("text"), (acc["full"] | ~whole).alias("full"))

    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))
    return F.aggregate(parts, start, step, lambda a: a["text"])
