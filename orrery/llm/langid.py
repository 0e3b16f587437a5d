"""Language identification by compression.

Each language has a zstandard raw-content dictionary drawn from a bounded
sample of its labelled texts. A text, lowered and without all but its letters
and number signs, is compressed in blocks with every dictionary;
the language whose dictionary gives the fewest bytes wins. The bytes between
the best and the second are the margin; narrow margins are rejected.

The sample is SAMPLE_ROWS distinct texts per language at most, those of the
smallest seeded hash. Whole texts are cut into chunks and every sampled text
gives a chunk, drawn by hash, then a second, until DICT_BYTES are reached;
predictions cover every row whole.
Null texts and texts without a letter get `und` with score 0; ties go to the
language first by code point; an empty table, or one with no labelled row,
gives `und` throughout.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import arrow_map, free, small_batches, thrifty

SAMPLE_ROWS = 128
#: Characters of a chunk of a sampled text, and the bytes a dictionary aims at.
CHUNK = 1_024
DICT_BYTES = 131_072
BLOCK_BYTES = 8_192
LEVEL = 6
#: A margin below this share of the best size, or under LEAST_BYTES, is narrow.
NARROW = 0.002
LEAST_BYTES = 2

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case words of letters, apart by single spaces."""
    return _OTHER.sub(" ", text.lower()).encode()


def held_out(key: Column) -> Column:
    """The fold that is kept from learning."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % 4 == 2


def has_letter(text: str) -> bool:
    """Whether a text has a character of category L (number signs are none)."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, size: int = DICT_BYTES, chunk: int = CHUNK) -> dict[str, bytes]:
    """Dictionaries by language from labelled rows.

    At most `rows` texts a language are drawn, and at most `rows` chunks and
    `size` characters' worth of further ones reach the driver.
    """
    d = df.filter(df[lang].isNotNull() & df[text].rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(7), F.col(text)).alias("h"))
    counts = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    # rows of small hash, several times more than needed; of these the smallest
    top = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(2**63 - 1, int(2.0**64 * min(1.0, 8.0 * rows / n)) - 2**63)))])
    drawn = d.filter(F.col("h") <= top[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    drawn = drawn.withColumn("i", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("i") <= rows)
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("text"), F.lit(1)), F.lit(chunk))
    parts = drawn.withColumn("at", F.explode(starts)).withColumn("p", F.substring("text", F.col("at"), F.lit(chunk)))
    own = W.partitionBy("lang", "h").orderBy(F.xxhash64("h", "at"), "at")
    parts = parts.withColumn("turn", F.row_number().over(own)).withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("turn", "h")))
    parts = parts.filter((F.col("turn") == 1) | (F.col("n") <= size // chunk * 2)).select("lang", "n", "turn", "p").collect()
    out: dict[str, list[bytes]] = {k: [] for k in sorted(counts)}
    full = dict.fromkeys(out, 0)
    for r in sorted(parts, key=lambda r: (r["lang"], r["n"])):
        raw = letters(r["p"])
        if r["turn"] == 1 or full[r["lang"]] < size:
            out[r["lang"]].append(raw)
            full[r["lang"]] += len(raw) + 1
    return {k: b" ".join(v) for k, v in out.items() if v}


def classifier(dictionaries: dict[str, bytes], block: int = BLOCK_BYTES, level: int = LEVEL):
    """A function from a text to (lang, score, margin in bytes, best size)."""
    import zstandard as zstd

    names = sorted(dictionaries)
    packers = []
    for k in names:
        d = zstd.ZstdCompressionDict(dictionaries[k], dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        packers.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def classify(text: str | None) -> tuple[str, float, int, int]:
        if not text or not names or not has_letter(text):
            return "und", 0.0, 0, 0
        raw = letters(text)
        sizes = [sum(len(p(raw[i : i + block])) for i in range(0, len(raw), block)) for p in packers]
        best = min(sizes)
        at = sizes.index(best)
        rest = sizes[:at] + sizes[at + 1 :]
        margin = min(rest) - best if rest else best
        score = 1 / sum(2.0 ** -min(s - best, 60) for s in sizes)
        return names[at], score, margin, best

    return classify


def predict(df: DataFrame, dictionaries: dict[str, bytes], key: str = "doc_id", text: str = "text", narrow: float = NARROW, least: int = LEAST_BYTES) -> DataFrame:
    """A row per document: lang_pred, score, margin and whether the margin suffices."""

    built: list = []

    def run(cols: list[list]) -> dict[str, list]:
        # built once a task, which gets its own copy of this function
        classify = built[0] if built else classifier(dictionaries)
        built[:] = [classify]
        got = [classify(t) for t in cols[1]]
        return {key: cols[0], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "margin": [g[2] for g in got], "accepted": [g[0] != "und" and g[2] >= max(least, narrow * g[3]) for g in got]}

    return arrow_map(df.select(key, text), run, f"`{key}` {df.schema[key].dataType.simpleString()}, lang_pred string, score double, margin long, accepted boolean")


def accepted(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", lang: str = "lang", narrow: float = NARROW, least: int = LEAST_BYTES) -> DataFrame:
    """All columns of the documents whose language is clear, `lang` set to it."""

    small_batches(df.sparkSession)

    def judged_batches(batches):
        classify = classifier(dictionaries)
        for texts in batches:
            got = [classify(t) for t in texts.to_pylist()]
            yield pa.array([{"lang": g[0], "ok": g[0] != "und" and g[2] >= max(least, narrow * g[3])} for g in got], pa.struct([("lang", pa.string()), ("ok", pa.bool_())]))

    @F.arrow_udf("struct<lang: string, ok: boolean>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return thrifty(judged_batches)(batches)

    judged = free(df, "judged")
    out = df.withColumn(judged, judge.asNondeterministic()(text)).filter(F.col(judged)["ok"])
    return out.withColumn(lang, F.col(judged)["lang"]).drop(judged)
