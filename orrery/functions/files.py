"""Files, names, years and loosely shaped values as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The first bytes of the known formats, the formats a kind of file may have, and
# the order of examinations within a year.
HEADS = {"25504446": ".pdf", "89504E470D0A1A0A": ".png", "FFD8": ".jpg", "504B0304": ".zip"}
FORMATS = {"problem": [".pdf"], "solution": [".pdf"], "answer": [".pdf", ".png", ".jpg"]}
LEAST_BYTES = 1024
KINDS = ["3월학평", "4월학평", "5월학평", "6월모평", "6월학평", "7월학평", "9월모평", "9월학평", "10월학평", "수능", "11월학평"]
LAST_KIND = 99


def extension(data: Column) -> Column:
    """The format that the first bytes show; null for an unknown one."""
    head, out = F.hex(F.substring(data, 1, 8)), F.lit(None).cast("string")
    for h, e in HEADS.items():
        out = F.when(F.startswith(head, F.lit(h)), e).otherwise(out)
    return out


def verified(data: Column, kind: Column) -> Column:
    """Whether a file is of a format that its kind may have and long enough not to be an error page."""
    found, ok = extension(data), F.lit(False)
    for k, es in FORMATS.items():
        ok = F.when(kind == k, found.isin(es)).otherwise(ok)
    return F.coalesce(ok & (F.octet_length(data) > LEAST_BYTES), F.lit(False))


def years(t: Column) -> Column:
    """The sorted, distinct years of `2020-2022,2025`; either end of a range may come first. Null if none."""
    def each(p: Column) -> Column:
        ends = F.transform(F.split(p, "-", 2), lambda x: F.trim(x).try_cast("int"))
        a = F.get(ends, F.lit(0))
        b = F.coalesce(F.get(ends, F.lit(1)), a)
        return F.when(a.isNotNull(), F.sequence(F.least(a, b), F.greatest(a, b)))

    found = F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.transform(F.split(t, ","), each)))))
    return F.when(F.size(found) > 0, found)


def exam_order(exam: Column) -> Column:
    """(year, kind's place, grade): sorts examinations as they are held; unknown kinds come last in a year."""
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.element_at(F.split(exam, "_"), -1)).cast("int")
    grade = F.regexp_extract(exam, r"^\d+_고(\d+)_[^_]*$", 1).try_cast("int")
    return F.struct(F.regexp_extract(exam, r"^(\d+)", 1).try_cast("int").alias("year"), F.when(place > 0, place).otherwise(LAST_KIND).alias("kind"), F.coalesce(grade, F.lit(0)).alias("grade"))


@F.pandas_udf(T.StringType())
def folded(names: pd.Series) -> pd.Series:
    """Compatibility forms first, then without white space, then case folded, so that a Roman numeral sign meets its letters."""
    return names.map(lambda n: None if n is None else "".join(unicodedata.normalize("NFKC", n).split()).casefold())


def public(m: Column) -> Column:
    """A map without the keys that begin with an underscore."""
    return F.map_filter(m, lambda k, _: ~F.startswith(k, F.lit("_")))


def strings(json: Column) -> Column:
    """A JSON string or list of strings as a list; anything else gives an empty one."""
    v = F.try_parse_json(json)
    many, one = F.try_variant_get(v, "$", "array<string>"), F.try_variant_get(v, "$", "string")
    kind = F.schema_of_variant(v)
    return F.when(F.startswith(kind, F.lit("ARRAY")), F.array_compact(many)).when(kind == "STRING", F.array(one)).otherwise(F.array().cast("array<string>"))


def unit_box(a: Column) -> Column:
    """Whether an array is four numbers from 0 to 1."""
    return F.coalesce((F.size(a) == 4) & F.forall(a, lambda x: x.isNotNull() & x.between(0, 1)), F.lit(False))


def unit_label(no: Column, title: Column) -> Column:
    return F.when(no.isNotNull(), F.concat(F.lit("("), no, F.lit(") "), title)).otherwise(title)
