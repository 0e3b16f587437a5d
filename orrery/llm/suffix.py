"""Exact removal of long repeated byte strings by a logarithmic index family.

A string of LENGTH bytes counts as repeated if it also starts anywhere else.
Every such string holds a sampled suffix: the winnowing anchor, which its own
bytes alone choose. So only anchors are indexed.

Pass 1 reads every text and lists its anchors, each with the hash of its first
GRAM bytes. Anchors whose hash occurs once cannot lie in a repeated string and
go, counted by a reduction before the shuffle. Pass 2 hands the surroundings of
the others to the index. The index is dealt by hash into shards; in a shard,
anchors arrive in batches. A batch becomes a sorted array of the suffixes that
start at each string around its anchors, is merge-scanned against every
existing level for matches of full length, and joins the family, where levels
of equal size merge, so there are at most log(batches) of them. Suffixes are
ordered by a 64-bit hash of their first LENGTH bytes, checked by a second one:
only full-length matches matter, for which any order serves that equal strings
share. Marked bytes are joined per text in a last pass.

The same index also holds strings of PASSAGE words, so that passages too short
in bytes are reported (not removed): `n_passages` counts the maximal runs of
words covered by such strings that another document holds too.

Texts that occur more than once are repeated as a whole; every distinct text is
indexed once. `Family` keeps levels of anchors and texts as written tables, so
that later batches meet earlier ones; equal-sized levels merge.

Null text is empty; texts under LENGTH bytes keep all; rows that
repeat get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

LENGTH = 400
GRAM = 128
#: Words of a passage, and of the grams that anchor it; a passage has twice as many bytes less one at least.
PASSAGE = 51
WORD_GRAM = 8
#: Anchors of a batch in a shard, and those a shard aims at: its memory is some 150 MB however large the input.
BATCH = 1_024
SHARD = 16_384
#: A hash that more anchors share is dealt on by whole strings, not in one shard.
HOT = 20_000
#: Texts are joined up to so many bytes for one round of array operations, which cost short texts more than their bytes do.
JOINED = 1 << 18

_RNG = np.random.default_rng(0x5EED)
TABLE1, TABLE2 = (_RNG.integers(1, 1 << 63, 256, dtype=np.uint64) for _ in range(2))
LOW = np.uint64(0xFFFFFFFF)
BASE1, BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Roller:
    """Hashes of all strings of one length in a text, by prefix sums modulo 2**64."""

    def __init__(self, table: np.ndarray, base: np.uint64):
        self.table, self.base, self.inv = table, base, _inverse(base)
        self.pow = self.neg = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.pow) <= n:
            self.pow, self.neg = _powers(self.base, 2 * n + 1), _powers(self.inv, 2 * n + 1)

    def _sums(self, values: np.ndarray) -> np.ndarray:
        n = values.shape[-1]
        self._grow(n)
        sums = np.zeros((*values.shape[:-1], n + 1), np.uint64)
        np.cumsum(values * self.pow[:n], axis=-1, out=sums[..., 1:])
        return sums

    def rolled(self, values: np.ndarray, width: int) -> np.ndarray:
        """Of the strings of `width` values along the last axis."""
        sums = self._sums(values)
        return _mix((sums[..., width:] - sums[..., :-width]) * self.neg[: values.shape[-1] - width + 1])

    def hashes(self, raw: np.ndarray, width: int) -> np.ndarray:
        """raw: bytes along the last axis."""
        return self.rolled(self.table[raw], width)

    def words(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each word: prefix sums at its ends."""
        solid = np.zeros(len(raw) + 2, np.int8)
        solid[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
        step = np.diff(solid)
        a, z = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        sums = self._sums(self.table[raw])
        return a, _mix((sums[z] - sums[a]) * self.neg[a])


def _joined(raws: list[bytes], size: int = JOINED):
    """(i, j, whole, begin, end): texts i..j-1 in one string with a space between, and where each begins and ends."""
    i = 0
    while i < len(raws):
        j, n = i + 1, len(raws[i])
        while j < len(raws) and n + len(raws[j]) < size:
            n += 1 + len(raws[j])
            j += 1
        sizes = np.fromiter(map(len, raws[i:j]), np.int64, j - i)
        end = np.cumsum(sizes + 1) - 1
        yield i, j, b" ".join(raws[i:j]), end - sizes, end
        i = j


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each window of w values."""
    n = 1
    while 2 * n <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def _within(begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All positions from begin[i] to before stop[i], in turn."""
    n = np.maximum(stop - begin, 0)
    return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


def _picked(h: np.ndarray, w: int, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, last): every string picks, of its w grams, the leftmost whose hash has the smallest upper half.

    An anchor is a picked gram; the strings that pick it start at first..last.
    h holds the gram hashes of joined texts, whose strings start at begin[i] to
    before stop[i]; what crosses from a text to the next is no string.
    """
    at = _within(begin, stop)
    if not len(at):
        return np.zeros(0, np.uint64), at, at
    place = np.arange(len(h), dtype=np.uint64)
    pick = (_least((h & ~LOW) | place, w)[at] & LOW).astype(np.int64)
    lo = np.flatnonzero(np.concatenate(([True], pick[1:] != pick[:-1])))  # picks never step back
    return h[pick[lo]], at[lo], at[np.append(lo[1:], len(at)) - 1]


class Levels:
    """A family of arrays of (hash, check, owner, text) in the order of hashes; equal-sized levels merge."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, ...]] = []

    def add(self, h: np.ndarray, c: np.ndarray, owner: np.ndarray, text: np.ndarray, seen: np.ndarray) -> None:
        """Scan a batch against the family and itself, flag repeated owners in `seen`, then join it.

        Equal strings repeat if their `text` differs; whoever counts repeats
        within a text as well gives every string a text of its own.
        """
        if not len(h):
            return
        order = np.argsort(h)
        again = h[order][1:] == h[order][:-1]
        if (again & (c[order][1:] != c[order][:-1])).any():  # strings of one hash but other checks
            order = np.lexsort((c, h))
        h, c, owner, text = h[order], c[order], owner[order], text[order]
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        at = np.flatnonzero(first)
        uh, uc, uo, ut = h[first], c[first], owner[first], text[first]
        wide = np.minimum.reduceat(text, at) != np.maximum.reduceat(text, at)
        met = np.zeros(len(uh), bool)
        for lh, lc, lo, lt in self.levels:
            at = np.searchsorted(lh, uh)
            open_ = at < len(lh)
            open_[open_] = lh[at[open_]] == uh[open_]
            while open_.any():  # entries of one hash but other checks follow each other
                i = np.flatnonzero(open_)
                hit = lc[at[i]] == uc[i]
                k, e = i[hit], at[i[hit]]
                met[k] = True
                other = seen[lo[e]] | wide[k] | (lt[e] != ut[k])
                seen[lo[e[other]]] = True
                wide[k[other]] = True
                open_[k] = False
                i = i[~hit]
                at[i] += 1
                more = at[i] < len(lh)
                more[more] = lh[at[i[more]]] == uh[i[more]]
                open_[i[~more]] = False
        seen[owner[wide[np.cumsum(first) - 1]]] = True
        fresh = ~met
        self.levels.append((uh[fresh], uc[fresh], uo[fresh], ut[fresh]))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            b, a = self.levels.pop(), self.levels.pop()
            h, c, o, t = (np.concatenate(x) for x in zip(a, b))
            order = np.argsort(h, kind="stable")  # two runs in order: a merge
            self.levels.append((h[order], c[order], o[order], t[order]))


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of True in a matrix."""
    f = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    f[:, 1:-1] = flags
    d = np.diff(f, axis=1)
    r, a = np.nonzero(d == 1)
    _, b = np.nonzero(d == -1)
    return r, a, b - 1


#: What a string is made of.
BYTES, WORDS = 0, 1
ANCHORS = "tid binary, unit byte, h long, lo int, hi int"


def _list_anchors(length: int, gram: int):
    def run(batches):
        roller = Roller(TABLE1, BASE1)
        least = min(length, 2 * PASSAGE - 1)
        for b in batches:
            raws = [raw for t in b.column(0).to_pylist() if len(raw := (t or "").encode()) >= least]
            names = pa.array([hashlib.sha256(raw).digest()[:16] for raw in raws], pa.binary())
            for i, _, whole, begin, end in _joined(raws):
                arr = np.frombuffer(whole, np.uint8)
                at, ws = roller.words(arr)
                first, stop = np.searchsorted(at, begin), np.searchsorted(at, end)  # words of each text
                found = [(BYTES, begin, _picked(roller.hashes(arr, gram), length - gram + 1, begin, end - length + 1))] if len(arr) >= length else []
                if len(ws) >= PASSAGE:
                    found.append((WORDS, first, _picked(roller.rolled(ws, WORD_GRAM), PASSAGE - WORD_GRAM + 1, first, stop - PASSAGE + 1)))
                for unit, start, (h, lo, hi) in found:
                    if len(h):
                        k = np.searchsorted(start, lo, "right") - 1
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(i + k)), pa.array(np.full(len(h), unit, np.int8)), pa.array(h.view(np.int64)), *(pa.array((x - start[k]).astype(np.int32)) for x in (lo, hi))], ["tid", "unit", "h", "lo", "hi"])

    return run


_NEAR = pa.schema([("tid", pa.binary()), ("unit", pa.int8()), ("h", pa.int64()), ("lo", pa.int32()), ("near", pa.binary())])


def _passages(raw: np.ndarray, rollers: tuple[Roller, Roller]) -> np.ndarray:
    """(strings of PASSAGE words, 2): hash and check of each."""
    _, ws = rollers[0].words(raw)
    return np.stack([r.rolled(ws, PASSAGE) for r in rollers], axis=1) if len(ws) >= PASSAGE else np.zeros((0, 2), np.uint64)


def _surroundings(length: int):
    """(tid, text, marks) rows in; per anchor the strings that pick it: their bytes, or hashes and checks of their words."""

    def run(batches):
        rollers = Roller(TABLE1, BASE1), Roller(TABLE2, BASE2)
        for b in batches:
            raws, marks, tids = [t.encode() for t in b.column("text").to_pylist()], b.column("marks"), b.column("tid")
            counts, flat = marks.value_lengths().to_numpy(), marks.flatten()
            text = np.repeat(np.arange(len(raws)), counts)
            unit, h, lo, hi = (flat.field(k).to_numpy() for k in ("unit", "h", "lo", "hi"))
            for i, j, whole, begin, _ in _joined(raws):
                here = slice(*np.searchsorted(text, (i, j)).tolist())
                for u in (BYTES, WORDS):
                    m = here.start + np.flatnonzero(unit[here] == u)
                    if not len(m):
                        continue
                    if u == WORDS:
                        arr = np.frombuffer(whole, np.uint8)
                        first = np.searchsorted(rollers[0].words(arr)[0], begin)
                        source, scale, start, more = _passages(arr, rollers).tobytes(), 16, first, 1
                    else:
                        source, scale, start, more = whole, 1, begin, length
                    a = (start[text[m] - i] + lo[m]) * scale
                    z = a + (hi[m] - lo[m] + more).astype(np.int64) * scale
                    for o in range(0, len(m), 4096):
                        p = m[o : o + 4096]
                        near = [source[x:y] for x, y in zip(a[o : o + 4096].tolist(), z[o : o + 4096].tolist())]
                        yield pa.RecordBatch.from_arrays([tids.take(pa.array(text[p])), *map(pa.array, (unit[p], h[p], lo[p])), pa.array(near, pa.binary())], schema=_NEAR)

    return run


def _strings(b: pa.RecordBatch, rollers: tuple[Roller, Roller], length: int):
    """The strings that pick each anchor: h, check, the anchor's row and the string's number in it; and which anchors are of words."""
    near, words = b.column("near"), b.column("unit").to_numpy() == WORDS
    size = pc.binary_length(near).to_numpy().astype(np.int64)
    rows = np.flatnonzero(~words)
    out = []
    if len(rows):
        raw = np.frombuffer(b"".join(near.take(pa.array(rows)).to_pylist()), np.uint8)
        end = np.cumsum(size[rows])
        at = _within(end - size[rows], end - length + 1)
        out.append((rows, size[rows] - length + 1, [r.hashes(raw, length)[at] for r in rollers]))
    rows = np.flatnonzero(words)
    if len(rows):
        x = np.frombuffer(b"".join(near.take(pa.array(rows)).to_pylist()), np.uint64).reshape(-1, 2)
        out.append((rows, size[rows] // 16, [x[:, 0], x[:, 1]]))
    h, c = (np.concatenate([x[k] for _, _, x in out]) for k in (0, 1))
    n = np.concatenate([n for _, n, _ in out])
    row = np.repeat(np.concatenate([r for r, _, _ in out]), n)
    h = h ^ _mix(b.column("h").to_numpy().view(np.uint64))[row]
    return h, c, row, _within(np.zeros(len(n), np.int64), n), words


def _width(length: int, gram: int) -> int:
    """Strings that can pick one anchor."""
    return max(length - gram, PASSAGE - WORD_GRAM) + 1


def _scan(length: int, gram: int, batch: int):
    """A shard's index: anchors in batches in, marked ranges out, of bytes or of words."""
    width = _width(length, gram)

    def run(batches):
        rollers = Roller(TABLE1, BASE1), Roller(TABLE2, BASE2)
        family, seen, tids, starts, units, n = Levels(), np.zeros(0, bool), [], [], [], 0
        numbers: dict[bytes, int] = {}  # of texts in this shard
        for whole in batches:
            for o in range(0, whole.num_rows, batch):
                b = whole.slice(o, batch)
                h, c, row, col, words = _strings(b, rollers, length)
                need = (n + b.num_rows) * width
                if need > len(seen):
                    seen = np.concatenate([seen, np.zeros(max(need, 2 * len(seen)) - len(seen), bool)])
                owner = (row + n) * width + col
                # bytes: repeats within a text count; so every string is a text of its own
                text, ids = -1 - owner, b.column("tid").to_pylist()
                number = np.zeros(b.num_rows, np.int64)
                for i in np.flatnonzero(words).tolist():
                    number[i] = numbers.setdefault(ids[i], len(numbers))
                text = np.where(words[row], number[row], text)
                family.add(h, c, owner, text, seen)
                tids.append(b.column("tid"))
                units.append(b.column("unit").to_numpy())
                starts.append(b.column("lo").to_numpy().astype(np.int64))
                n += b.num_rows
        if n:
            r, a, z = _runs(seen[: n * width].reshape(n, width))
            if len(r):
                at, unit = np.concatenate(starts)[r], np.concatenate(units)[r]
                ids = pa.chunked_array(tids).combine_chunks().take(pa.array(r))
                ends = at + z + np.where(unit == WORDS, PASSAGE, length)
                yield from pa.Table.from_arrays([ids, pa.array(unit), pa.array((at + a).astype(np.int32)), pa.array(ends.astype(np.int32))], ["tid", "unit", "a", "b"]).to_batches(20_000)

    return run


def _spread(length: int):
    """Of anchors with a hot hash: a row per string, to be counted by a reduction."""

    def run(batches):
        rollers = Roller(TABLE1, BASE1), Roller(TABLE2, BASE2)
        for whole in batches:
            for o in range(0, whole.num_rows, 1024):
                b = whole.slice(o, 1024)
                h, c, row, col, words = _strings(b, rollers, length)
                at = b.column("lo").to_numpy().astype(np.int64)[row] + col
                yield pa.RecordBatch.from_arrays([b.column("tid").take(pa.array(row)), pa.array(words.astype(np.int8)[row]), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))], ["tid", "unit", "a", "s1", "s2"])

    return run


def _remove():
    """Texts and their ranges in; removed bytes, spans, the rest and the number of repeated passages out."""
    schema = pa.schema([("tid", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("n_passages", pa.int64())])

    def run(batches):
        rollers = Roller(TABLE1, BASE1), Roller(TABLE2, BASE2)
        for b in batches:
            out = {c: [] for c in schema.names}
            for r in b.to_pylist():
                raw, kept, at, gone, spans = r["text"].encode(), [], 0, 0, 0
                for x in sorted((x for x in r["ranges"] if x["unit"] == BYTES), key=lambda x: x["a"]):
                    if x["b"] <= at and spans:
                        continue
                    if x["a"] > at or not spans:
                        kept.append(raw[at : x["a"]])
                        spans += 1
                        gone += x["b"] - x["a"]
                    else:
                        gone += x["b"] - at
                    at = x["b"]
                kept.append(raw[at:])
                runs = 0
                met = [(x["a"], x["b"] - PASSAGE) for x in r["ranges"] if x["unit"] == WORDS]
                if met:  # a string that another text holds may stand here more than once
                    hashed = _passages(np.frombuffer(raw, np.uint8), rollers)
                    mine = np.concatenate([hashed[a : z + 1, 0] for a, z in met])
                    starts = np.flatnonzero(np.isin(hashed[:, 0], mine))
                    runs = 1 + int((np.diff(starts) > PASSAGE).sum())
                for k, v in zip(out, (r["tid"], gone, spans, b"".join(kept), runs)):
                    out[k].append(v)
            if out["tid"]:
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _tid(text):
    return F.unhex(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 32))


def _texts(df: DataFrame, text: str, length: int) -> tuple[DataFrame, DataFrame]:
    """(body, distinct): every text; each distinct one that can hold a string, with its id."""
    t = df.select(F.coalesce(df[text], F.lit("")).alias("text"))
    long = t.filter(F.octet_length("text") >= min(length, 2 * PASSAGE - 1))
    return t, long.withColumn("tid", _tid(F.col("text"))).groupBy("tid").agg(F.first("text").alias("text"))


def _shared(found: DataFrame) -> DataFrame:
    """Hashes of anchors that stand in more than one place.

    A written table: the join against it then has two plain shuffles below it,
    so that a hash of very many anchors is split at run time.
    """
    place = F.struct("tid", "lo")
    return cut(found.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo <> hi").select("h"))


def _marked(found: DataFrame, shared: DataFrame) -> DataFrame:
    return found.join(shared, "h", "left_semi").groupBy("tid").agg(F.collect_set(F.struct("unit", "h", "lo", "hi")).alias("marks"))


def _ranges(texts: DataFrame, length: int, gram: int, batch: int, hot: int) -> DataFrame:
    """(tid, unit, a, b): what the index family finds among texts (tid, text, marks)."""
    near = texts.mapInArrow(_surroundings(length), "tid binary, unit byte, h long, lo int, near binary")
    m = texts.select(F.explode("marks").alias("m"))
    per = m.groupBy("m.h").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut(per.groupBy((F.col("n") > hot).alias("hot")).agg(F.sum("n").alias("n"))).collect()
    total = {r["hot"]: r["n"] for r in sizes}
    ranges = None
    if total.get(True):
        many = cut(per.filter(F.col("n") > hot).select("h"))
        near = cut(near)
        near, warm = near.join(many, "h", "left_anti").select(near.columns), near.join(many, "h", "left_semi").select(near.columns)
        rows = cut(warm.mapInArrow(_spread(length), "tid binary, unit byte, a int, s1 long, s2 long"))
        place = F.struct("tid", F.when(F.col("unit") == BYTES, F.col("a")).alias("a"))
        twice = cut(rows.groupBy("unit", "s1", "s2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("NOT (lo <=> hi)").select("unit", "s1", "s2"))
        end = F.col("a") + F.when(F.col("unit") == BYTES, F.lit(length)).otherwise(F.lit(PASSAGE))
        ranges = rows.join(twice, ["unit", "s1", "s2"], "left_semi").select("tid", "unit", "a", end.alias("b"))
    shards = max(1, -(-total.get(False, 0) // SHARD))
    scanned = near.repartition(shards, "h").mapInArrow(_scan(length, gram, batch), "tid binary, unit byte, a int, b int")
    return scanned if ranges is None else scanned.unionByName(ranges)


def repeated(df: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, batch: int = BATCH, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(texts, ranges): distinct texts that may hold repeats, as (tid, text, marks); marked ranges (tid, unit, a, b)."""
    t, distinct = _texts(df, text, length)
    found = cut(t.mapInArrow(_list_anchors(length, gram), ANCHORS))
    texts = cut(distinct.join(_marked(found, _shared(found)), "tid"))
    return texts, _ranges(texts, length, gram, batch, hot)


def _outcome(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """tid, n_removed, n_spans, kept, n_passages of each distinct text with a range."""
    per = ranges.groupBy("tid").agg(F.collect_set(F.struct("unit", "a", "b")).alias("ranges"))
    return texts.select("tid", "text").join(per, "tid").mapInArrow(_remove(), "tid binary, n_removed long, n_spans long, kept binary, n_passages long")


def _result(df: DataFrame, key: str, text: str, length: int, gram: int, batch: int, hot: int, form) -> DataFrame:
    """A row per document; `form` makes `kept` of remaining bytes, before any of them is shuffled."""
    texts, ranges = repeated(df, text, length, gram, batch, hot)
    body = F.coalesce(df[text], F.lit(""))
    passage = F.lit(r"(?s)^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){%d}[^\x20\x09-\x0D]" % (PASSAGE - 1))
    d = df.select(df[key].alias("_key"), form(F.encode(body, "UTF-8")).alias("own"), F.octet_length(body).cast("long").alias("n_bytes"), F.regexp_like(body, passage).alias("long"), _tid(body).alias("tid"))
    d = cut(d)
    copies = d.groupBy("tid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("tid", F.lit(True).alias("copied"))
    of = copies.join(_outcome(texts, ranges).withColumn("kept", form(F.col("kept"))), "tid", "full_outer")
    copied = F.coalesce(F.col("copied"), F.lit(False))
    whole = copied & (F.col("n_bytes") >= length)
    gone = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    one = F.lit(1).cast("long")
    return d.join(of, "tid", "left").select(
        F.col("_key").alias(key),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(gone("n_removed")).alias("n_removed"),
        F.when(whole, one).otherwise(gone("n_spans")).alias("n_spans"),
        F.when(whole, form(F.encode(F.lit(""), "UTF-8"))).otherwise(F.coalesce("kept", "own")).alias("kept"),
        F.when(copied & F.col("long"), one).otherwise(gone("n_passages")).alias("n_passages"),
    )


def cleaned(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, batch: int = BATCH, hot: int = HOT) -> DataFrame:
    """A row per document: key, n_bytes, n_removed, n_spans, n_passages and kept, its remaining bytes (a cut may fall inside a character)."""
    return _result(df, key, text, length, gram, batch, hot, lambda raw: raw)


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, batch: int = BATCH, hot: int = HOT) -> DataFrame:
    """A row per document: key, n_bytes, n_removed, n_spans, kept_sha256, n_passages."""
    return _result(df, key, text, length, gram, batch, hot, lambda raw: F.sha2(raw, 256)).withColumnRenamed("kept", "kept_sha256")


class Family:
    """Levels of indexed texts in a shared folder, which later batches are scanned against.

    A level is two tables, texts (tid, text) and their anchors, and the number
    of anchors. A batch is scanned against itself and every level; then it
    becomes a level, and levels of about equal size merge, so that there are
    at most log(batches) of them. The list of levels is a small table of its
    own, written anew at each step; a batch counts once its list is written.
    """

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, gram: int = GRAM):
        self.spark, self.path, self.length, self.gram, self.step = spark, path.rstrip("/"), length, gram, 0
        self.levels: list[tuple[str, int]] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str, step: int, length: int = LENGTH, gram: int = GRAM) -> Family:
        """The family as its `step`-th batch left it."""
        f = cls(spark, path, length, gram)
        f.step = step
        f.levels = [(r["name"], r["n"]) for r in spark.read.parquet(f"{f.path}/levels-{step}").orderBy("i").collect()]
        return f

    def _table(self, name: str, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/{kind}")

    def _write(self, texts: DataFrame, found: DataFrame) -> tuple[str, int]:
        name = f"level-{uuid.uuid4().hex}"
        texts.write.parquet(f"{self.path}/{name}/texts")
        found.repartitionByRange("h").sortWithinPartitions("h").write.parquet(f"{self.path}/{name}/anchors")
        return name, self._table(name, "anchors").count()

    def add(self, df: DataFrame, text: str = "text", batch: int = BATCH, hot: int = HOT) -> DataFrame:
        """Index a batch; (tid, unit, a, b): ranges that it repeats, in it and in earlier texts.

        A text that the family already holds adds nothing to it; it, like a text
        that occurs twice in a batch, repeats as a whole by its tid alone.
        """
        _, distinct = _texts(df, text, self.length)
        fresh = distinct.select("tid", "text")
        for name, _ in self.levels:
            fresh = fresh.join(self._table(name, "texts").select("tid"), "tid", "left_anti")
        fresh = cut(fresh)
        found = cut(fresh.select("text").mapInArrow(_list_anchors(self.length, self.gram), ANCHORS))
        texts, every = fresh, found
        for name, _ in self.levels:
            met = self._table(name, "anchors").join(found.select("h").distinct(), "h", "left_semi").select(*found.columns)
            texts, every = texts.unionByName(self._table(name, "texts")), every.unionByName(met)
        every = cut(every)
        marked = cut(texts.join(_marked(every, _shared(every)), "tid"))
        ranges = cut(_ranges(marked, self.length, self.gram, batch, hot))
        self.levels.append(self._write(fresh, found))
        while len(self.levels) > 1 and self.levels[-2][1] <= 2 * self.levels[-1][1]:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._write(*(self._table(a[0], k).unionByName(self._table(b[0], k)) for k in ("texts", "anchors"))))
        self.step += 1
        rows = [(i, name, n) for i, (name, n) in enumerate(self.levels)]
        self.spark.createDataFrame(rows, "i int, name string, n long").coalesce(1).write.parquet(f"{self.path}/levels-{self.step}")
        return ranges
