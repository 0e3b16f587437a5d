"""Keys, marks and points of exams as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import text as ft


def exam_year(exam: Column) -> Column:
    return F.when(exam.rlike(r"^\d{4}_"), F.substring(exam, 1, 4).cast("int"))


def exam_grade(exam: Column) -> Column:
    got = F.regexp_extract(exam, r"^\d{4}_고(\d)_", 1)
    return F.when(got != "", got.cast("int"))


def exam_kind(exam: Column) -> Column:
    got = F.regexp_extract(exam, r"^\d{4}_(?:고\d_)?(.+)$", 1)
    return F.when(got != "", got)


def exam_id(year: Column, kind: Column, grade: Column) -> Column:
    return F.concat_ws("_", year.cast("string"), F.when(grade.isNotNull(), F.concat(F.lit("고"), grade.cast("string"))), kind)


def qid(exam: Column, number: Column) -> Column:
    return F.concat(exam, F.lit("_"), F.lpad(number.cast("string"), 2, "0"))


def qid_exam(q: Column) -> Column:
    """Null for a malformed key."""
    got = F.regexp_extract(q, r"^(.+)_(\d{2})$", 1)
    return F.when(got != "", got)


def qid_number(q: Column) -> Column:
    return F.when(q.rlike(r"_\d{2}$"), F.substring(q, -2, 2).cast("int"))


def mark_points(t: Column) -> Column:
    """Points from a mark like [3점], [2.5점] or [ 3 점 ]; null without one."""
    # Fixed value: the mark's form.
    got = F.regexp_extract(t, r"\[\s*(\d+(?:\.\d+)?)\s*점\s*\]", 1)
    return F.when(got != "", got.cast("double"))


def cell_points(cell: Column) -> Column:
    """Points from a table cell that is a number over 0, at most 10; null otherwise."""
    t = F.btrim(cell)
    v = F.when(t.rlike(r"^\d+(?:\.\d+)?$"), t.cast("double"))
    return F.when((v > 0) & (v <= 10), v)


def cell_ratio(cell: Column) -> Column:
    """A number from 0 to 100 from a cell with or without per cent signs; null otherwise."""
    v = ft.number(F.regexp_replace(F.btrim(cell), "%+$", ""))
    return F.when((v >= 0) & (v <= 100), v)


def points_label(points: Column) -> Column:
    """2.0 as 2, 1.5 as it is."""
    return F.when(points == F.floor(points), points.cast("long").cast("string")).otherwise(points.cast("string"))


def on_grid(x: Column, grid: float = 0.5) -> Column:
    return F.abs(x / grid - F.round(x / grid)) <= 1e-6


def same_points(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= 1e-6, a.isNull() & b.isNull())


def prefix(code: Column) -> Column:
    """A standard's code without its last five characters."""
    return F.when(F.length(code) > 5, F.substring(code, F.lit(1), F.length(code) - 5))
