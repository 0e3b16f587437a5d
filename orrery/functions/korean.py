"""Normalised text, particles and terms as Column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text as ft
from orrery.functions.arrow import small_batches

# Private-use characters of two print fonts and old consonants, and what they stand for.
DIGIT_GLYPHS = "\ue034\ue035\ue036\ue037\ue038\ue039\ue03a\ue03b\ue03c\ue03d\ue046\ue053\ue047\ue04f\ue06d"
DIGITS_MEANT = "1234567890-+=:/"
#: (first code point, the letters that follow in order)
LETTER_BLOCKS = [(0xE000, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (0xE085, "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), (0xE09D, "αβγδεζηθικλμνξοπρστυφχψω"), (0xE0E5, "abcdefghijklmnopqrstuvwxyz")]
SIGN_GLYPHS = "\ue044\ue045\ue048\ue04d\ue054\ue055\ue056\ue05c\ue101\ue052\ue0bb\ue0c2\ue0c8"
SIGNS_MEANT = "()+|/<>√|,lφ°"
OLD_CONSONANTS = "ᄀᄂᄃᄅᄆᄇᄉᄋ"
CONSONANTS_MEANT = "ㄱㄴㄷㄹㅁㅂㅅㅇ"
# Particles that end a token, in the order they are tried.
TERM_PARTICLES = "에서는 으로는 에게서 이라는 라는 에서 에게 으로 까지 부터 보다 처럼 마다 조차 라도 이나 와의 과의 의 은 는 이 가 을 를 와 과 도 만 로 에 나 란 며 고".split()
# Particles that end a noun in running text; longer ones are tried first, equal ones in this order.
NOUN_PARTICLES = "으로부터 로부터 에서의 에게서 이라는 으로써 으로서 에서는 에서도 이라고 등으로 등에서 라는 로써 로서 에서 에게 까지 부터 보다 처럼 마다 만큼 이나 으로 와의 과의 에는 에도 등의 등을 등이 들의 들을 들이 등과 등에 이며 를 을 이 가 은 는 과 와 에 로 나 등 들".split()


def glyphs() -> tuple[str, str]:
    """Every mapped character and, in the same place, what it stands for."""
    blocks = [("".join(chr(a + i) for i in range(len(x))), x) for a, x in LETTER_BLOCKS]
    return DIGIT_GLYPHS + "".join(b for b, _ in blocks) + SIGN_GLYPHS + OLD_CONSONANTS, DIGITS_MEANT + "".join(x for _, x in blocks) + SIGNS_MEANT + CONSONANTS_MEANT


def nfkc(t: Column) -> Column:
    """Compatibility composition; Spark has no function for it, so texts go by in Arrow batches.

    Only texts beyond ASCII go, in batches bounded by bytes: a batch of a number
    of rows takes memory as the texts grow.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        small_batches(spark)

    @F.arrow_udf("string")
    def composed(texts: pa.Array) -> pa.Array:
        return pa.array([x if x is None else unicodedata.normalize("NFKC", x) for x in texts.to_pylist()], pa.string())

    return F.coalesce(composed(F.when(F.octet_length(t) > F.length(t), t)), t)


def cleaned(t: Column) -> Column:
    """What `normalised` does after NFKC."""
    t = F.translate(F.translate(t, " ", " "), *glyphs())
    # control characters but line break and tab, and what private-use characters are left
    t = F.regexp_replace(t, r"[\x00-\x08\x0B-\x1F\x{80}-\x{9F}\x{E000}-\x{F8FF}]", "")
    t = F.regexp_replace(t, r"(?U)<\s*보\s*기\s*>", "<보기>")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit(" \n\t"))


def normalised(t: Column) -> Column:
    """Text that parsers can rely on; null is empty."""
    return cleaned(nfkc(F.coalesce(t, F.lit(""))))


def flattened(t: Column) -> Column:
    """White space runs, line breaks included, as single spaces."""
    return F.btrim(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s+", " "))


def squashed(t: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s+", "")


def stem(token: Column) -> Column:
    """A term's token without its particle, if at least two characters stay."""
    ends = F.filter(F.array(*[F.lit(p) for p in TERM_PARTICLES]), lambda p: (F.length(token) > F.length(p) + 1) & F.endswith(token, p))
    return F.when(F.size(ends) > 0, F.substring(token, F.lit(1), F.length(token) - F.length(F.get(ends, F.lit(0))))).otherwise(token)


def noun_stem(token: Column) -> Column:
    """(stem, ends): a noun without its particle and whether its phrase ends here; a genitive goes on."""
    ordered = sorted(NOUN_PARTICLES, key=len, reverse=True)
    ends = F.filter(F.array(*[F.lit(p) for p in ordered]), lambda p: (F.length(token) - F.length(p) >= 2) & F.endswith(token, p))
    genitive = F.endswith(token, F.lit("의")) & (F.length(token) > 2)
    cut = F.substring(token, F.lit(1), F.length(token) - F.length(F.get(ends, F.lit(0))))
    none = F.struct(token.alias("stem"), F.lit(False).alias("ends"))
    return F.when(genitive | (F.size(ends) == 0), none).otherwise(F.struct(cut.alias("stem"), F.lit(True).alias("ends")))


def stemmed_terms(t: Column) -> Column:
    """Distinct stems of two characters and more that are no numbers, and pairs of neighbours; t is NFKC text.

    One expression finds each run of letters and digits and the shortest stem
    that a particle or nothing follows, as `stem` takes the longest particle;
    runs that leave a number are passed over.
    """
    run = "[가-힣A-Za-z0-9]"
    particle = f"(?=[{''.join(sorted({p[0] for p in TERM_PARTICLES}))}])(?:{'|'.join(TERM_PARTICLES)})"
    word = f"(?<!{run})(?![0-9]{{2,}}+(?:{particle})?(?!{run}))({run}{{2,}}?)(?:{particle})?(?!{run})"
    return ft.with_pairs(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(word), F.lit(1)))
