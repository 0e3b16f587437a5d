"""Personal data, found also behind disguises, with offsets into the source.

Base spans come from four plain patterns, leftmost and non-overlapping per
kind. Then transducers rewrite disguises - look-alike characters, invisible
characters, spelled digits, at/dot words - into a normalised text that keeps,
for each rewritten piece, where it came from. The same patterns run on the
normalised text; a hit that touches a rewritten piece is mapped back to source
characters and added. Base spans always stay.

Offsets are in code points, the end exclusive. Null text counts as empty;
texts of any length are scanned whole, in linear time; repeated rows get equal
results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, small_batches, thrifty

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters and digits that look like ASCII ones, by ASCII form.
LOOKALIKES = {
    "a": "аα", "b": "ЬƄ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іıι", "j": "ј", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "u": "υս", "v": "ν", "w": "ԝ", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
    "-": "‐‑‒–—−﹣", ".": "․。·∙•", "+": "﬩", "@": "﹫",
}
INVISIBLE = "­​‌‍⁠﻿"
# Number words, each list from zero to nine.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
AT_WORDS = "at|arroba|arobase|ät"
DOT_WORDS = "dot|punkt|punto|point"
# Which words for a dot go with which for an at.
PAIRS = {"at": {"dot", "punkt"}, "ät": {"punkt"}, "arroba": {"punto"}, "arobase": {"point"}, "@": {"dot", "punkt", "punto", "point"}}
# Top-level domains that a disguise without brackets must end in: any of the first, or any of the further ones
# (all country codes and the common generic ones) unless the host begins with a word as in "look at the dot in the middle".
TLDS = "com|org|net|edu|gov|info|io|co|de|fr|es|eu|uk|us|ch|at|example|test"
MORE_TLDS = (
    "ac ad ae af ag ai al am ao aq ar as au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ci ck cl cm cn cr cu cv cw cx cy cz dj dk dm do dz ec ee eg er et fi fj fk fm fo ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw "
    "mil int biz name pro aero coop museum mobi jobs travel tel cat asia post arpa app dev tech online site xyz shop store blog cloud club live news email web page wiki academy agency bank city company design digital link media network space website world group global software solutions systems services berlin hamburg koln wien paris london nyc"
).split()
NOT_HOSTS = frozenset("the a an this that these those each every any some our your my his her its their one which der die das dem den ein eine einem le la les un une el los las una".split())

_FROM = {ch: a for a, chars in LOOKALIKES.items() for ch in chars}
_DIGIT = {w: str(i) for ws in DIGIT_WORDS for i, w in enumerate(ws.split())} | {"oh": "0"}
_WORD = "(?:" + "|".join(sorted(_DIGIT, key=len, reverse=True)) + ")"
_ODD = re.compile("[^\u0000-\u007f¡-¬®-¶¸-ɏ]")
# a line that begins with a number and a full stop is a list's next item
_GLUE = r"(?:[ \t,./()-]{1,4}|[ \t,()/-]{0,3}\r?\n(?![0-9]+\.[ \t])[ \t(]{0,3})"
_GAP = r"[ \t\r\n]+"
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:plus{_GAP}\(?)?(?:{_WORD}|[0-9]+)(?:(?:{_GLUE}|{_GAP}(?:{DOT_WORDS}){_GAP})(?:{_WORD}|[0-9]+))+(?!\w)")
_TOKEN = re.compile(rf"(?i)(?P<plus>plus{_GAP}\(?)|(?P<dot>{_GAP}(?:{DOT_WORDS}){_GAP})|(?P<word>(?<!\w){_WORD}(?!\w))|(?P<glue>[ \t\r\n,/()-]+)")
_ENTITY = re.compile(r"(?i)&#(?:0*(?P<dec>6[4]|4[63])|x0*(?P<hex>40|2e|2b));|&(?P<name>commat|period|plus);|%40")
_OPEN, _CLOSE = r"[ \t]*[\[({<][ \t]*", r"[ \t]*[\])}>][ \t]*"
_BRACKET = re.compile(rf"(?i){_OPEN}(?:(?P<at>{AT_WORDS}|@)|(?P<dot>{DOT_WORDS}|\.)){_CLOSE}")
_BARE = re.compile(rf"(?i)(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]+(?P<at>[ \t]+(?:{AT_WORDS})[ \t]+|[ \t]*@[ \t]*)(?P<host>[A-Za-z0-9-]+(?:(?:[ \t]+(?:{DOT_WORDS})[ \t]+|\.)[A-Za-z0-9-]+)+)(?![A-Za-z0-9-])")
_BARE_DOT = re.compile(rf"(?i)[ \t]+(?:{DOT_WORDS})[ \t]+")
_TLD = re.compile(rf"(?i)\.(?:(?P<sure>{TLDS})|{'|'.join(MORE_TLDS)}|xn--[a-z0-9-]+)$")
_LOCAL_DOT = re.compile(rf"(?i)(?<=[A-Za-z0-9])[ \t]+(?:{DOT_WORDS})[ \t]+(?=[A-Za-z0-9])")
_REST = re.compile(r"[A-Za-z0-9._%+-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(t: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind by the plain patterns alone."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in t:
        end = 0
        for m in _DOMAIN.finditer(t):
            at = m.start()
            back = t[end:at][::-1] if at - end < 64 else t[at - 64 : at][::-1]
            n = _LOCAL.match(back).end()
            if n == len(back) and at - n > end:  # a long local part
                n = _LOCAL.match(t[end:at][::-1]).end()
            if n:
                end = m.end()
                out["email"].append((at - n, end))
    for m in _IP.finditer(t):
        if all(len(p) < 4 and int(p or 0) <= 255 for p in [x.lstrip("0") for x in m[0].split(".")]):
            out["ip"].append(m.span())
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out["phone"].append(m.span())
    return out


class Normalised:
    """A text after some rewrites, with the way back to the source's offsets.

    Rewrites compose: each step edits the current text, and offsets map
    through the steps in reverse.
    """

    def __init__(self, text: str):
        self.text = text
        self.steps: list[tuple[list[int], list[tuple[int, int, int, int]]]] = []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply sorted, disjoint (start, end, new) edits."""
        if not edits:
            return
        parts, marks, at, size = [], [], 0, 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            size += a - at
            marks.append((size, size + len(new), a, b))
            size += len(new)
            at = b
        parts.append(self.text[at:])
        self.text = "".join(parts)
        self.steps.append(([m[0] for m in marks], marks))

    def source(self, a: int, b: int) -> tuple[int, int, bool]:
        """Source span of [a, b) and whether it touches a rewritten piece."""
        touched = False
        for starts, marks in reversed(self.steps):
            i, j = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
            lo = marks[i] if i >= 0 else None
            hi = marks[j] if j >= 0 else None
            touched |= j > i or bool(lo and a < lo[1])
            a2 = a if lo is None else (lo[2] if a < lo[1] else lo[3] + a - lo[1])
            b2 = b if hi is None else (hi[3] if b <= hi[1] else hi[3] + b - hi[1])
            a, b = a2, b2
        return a, b, touched


def _looks(t: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _ODD.finditer(t):
        c = m[0]
        if c in INVISIBLE:
            new = ""
        elif (new := _FROM.get(c)) is None:
            folded = unicodedata.normalize("NFKC", c)
            digit = unicodedata.digit(c, None)
            new = folded if len(folded) == 1 and folded < "\x7f" else str(digit) if digit is not None else None
        if new is not None:
            edits.append((m.start(), m.end(), new))
    return edits


def _entities(t: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _ENTITY.finditer(t):
        if m["dec"]:
            new = chr(int(m["dec"]))
        elif m["hex"]:
            new = chr(int(m["hex"], 16))
        else:
            new = {"commat": "@", "period": ".", "plus": "+"}.get((m["name"] or "commat").lower(), "@")
        edits.append((m.start(), m.end(), new))
    return edits


def _spelled(t: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED.finditer(t):
        found = list(_TOKEN.finditer(t, m.start(), m.end()))
        if all(k.lastgroup == "glue" for k in found):
            continue
        for k in found:
            kind = k.lastgroup
            new = {"plus": "+", "dot": ".", "glue": ""}.get(kind)
            if kind == "glue" and not (_joins(t, k.start(), k.end())):
                continue
            edits.append((k.start(), k.end(), _DIGIT[k[0].lower()] if new is None else new))
    return edits


def _joins(t: str, a: int, b: int) -> bool:
    """A gap next to a spelled digit vanishes; one between figures stays as it is."""
    return not (t[a - 1].isdigit() and b < len(t) and t[b].isdigit())


def _bracketed(t: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKET.finditer(t)]


def _bare(t: str) -> list[tuple[int, int, str]]:
    """Without brackets, a disguise needs a known top-level domain and words of one language."""
    edits = []
    for m in _BARE.finditer(t):
        dots = [(m.start("host") + d.start(), m.start("host") + d.end(), ".") for d in _BARE_DOT.finditer(m["host"])]
        named = {t[a:b].strip().lower() for a, b, _ in dots}
        at = m["at"].strip().lower()
        if not named <= PAIRS[at] or at == "@" and not dots and m["at"] == "@":
            continue
        host = _BARE_DOT.sub(".", m["host"])
        top = _TLD.search(host)
        if top and (top["sure"] or host[: host.index(".")].lower() not in NOT_HOSTS):
            edits += [(m.start("at"), m.end("at"), "@"), *dots]
    return edits


def _local_dots(t: str) -> list[tuple[int, int, str]]:
    """Dot words of local parts: what follows one runs up to an @ or to another such word. From the last to the first, in linear time."""
    edits, good = [], -1
    for m in reversed(list(_LOCAL_DOT.finditer(t))):
        end = _REST.match(t, m.end()).end()
        if end == good or t[end : end + 1] == "@":
            good = m.start()
            edits.append((m.start(), m.end(), "."))
    return edits[::-1]


def normalise(t: str) -> Normalised | None:
    """The text with its disguises undone, or None if it holds none."""
    low = None
    n = Normalised(t)
    if not t.isascii():
        n.rewrite(_looks(t))
    if "&" in n.text or "%40" in n.text:
        n.rewrite(_entities(n.text))
    low = n.text.lower()
    if any(w in low for w in _HINTS):
        n.rewrite(_spelled(n.text))
        low = n.text.lower()
    if any(c in low for c in "[({<"):
        n.rewrite(_bracketed(n.text))
        low = n.text.lower()
    dotted = any(w in low for w in DOT_WORDS.split("|"))
    if dotted or "." in low and any(w in low for w in _AT_HINTS):
        n.rewrite(_bare(n.text))
    if dotted and "@" in n.text:
        n.rewrite(_local_dots(n.text))
    return n if n.steps else None


#: Without one of these, no run is spelled; or no address has its @ spelled or set apart.
_HINTS = (*sorted(_DIGIT), *DOT_WORDS.split("|"), "plus")
_AT_HINTS = (*(f"{g}{w}" for g in " \t" for w in AT_WORDS.split("|")), " @", "\t@", "@ ", "@\t")


def find(t: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base, added): spans by kind; added ones come from undone disguises."""
    t = t or ""
    base = base_spans(t)
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    n = normalise(t)
    if n is not None:
        for kind, spans in base_spans(n.text).items():
            have = set(base[kind])
            for a, b in spans:
                s, e, touched = n.source(a, b)
                if touched and (s, e) not in have:
                    added[kind].append((s, e))
    return base, added


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def mask(t: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets."""
    if t is None:
        return None
    base, added = find(t)
    spans = sorted((a, b, k) for d in (base, added) for k in KINDS for a, b in d[k])
    if not spans:
        return t
    out, at = [], 0
    for a, b, k in spans:
        if b <= at:
            continue
        if a >= at:
            out += [t[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join(out) + t[at:]


def spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: counts of base spans, digest of base spans, all spans."""

    def run(cols: list[list]) -> dict[str, list]:
        out: dict[str, list] = {key: cols[0]} | {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": [], "n_added": []}
        for t in cols[1]:
            base, added = find(t)
            for k in KINDS:
                out[f"n_{k}"].append(len(base[k]))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined({k: base[k] + added[k] for k in KINDS}))
            out["n_added"].append(sum(map(len, added.values())))
        return out

    kind = df.schema[key].dataType.simpleString()
    return arrow_map(df.select(key, text), run, f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns, with the text's personal data replaced."""
    small_batches(df.sparkSession)

    @F.arrow_udf("string")
    def hide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return thrifty(lambda it: (pa.array([mask(t) for t in texts.to_pylist()], pa.string()) for texts in it))(batches)

    return df.withColumn(text, hide(text))
