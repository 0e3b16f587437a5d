"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has a bit set where more than half the hashes of the text's word
shingles (repeats included) have it set. Equal fingerprints collapse into one
class first. Fingerprints are cut into blocks; two that differ in at most
`radius` bits agree in all blocks but `radius`, so each class is dealt once for
every choice of the blocks that must agree, and classes that meet are verified
by Hamming distance. A meeting place hands on the links of a spanning forest,
not all its pairs; large meeting places are divided further, without loss.

64 bits tell texts of similarity 0.8 apart too coarsely, so near copies use
wide fingerprints, cut into many short blocks: two texts meet if one block
agrees, and link if they differ in at most a share of all bits. The length of a
block grows with the number of rows, so that few strangers meet, and the number
of blocks with it, so that as many near copies do (see `shape`).

Null text has no words; a text with fewer words than a shingle is one shingle;
no words give fingerprint zero, linked like any other. Repeated rows share a
class. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, free, thrifty
from .components import components

SEED = 42


#: Shingles whose bits are counted at a time.
SLICE = 1 << 16
_RNG = np.random.default_rng(0xF1A6)
TABLE, BASE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64), np.uint64(0x9E3779B97F4A7C15)
#: Of wide fingerprints: texts of this similarity differ in arccos(2s / (1 + s)) / pi of the bits in expectation.
SIMILARITY = 0.8
#: Standard deviations that the radius lies beyond that; share of such pairs that meet; strangers a place may expect.
BEYOND, MEET, STRANGERS = 1.9, 0.95, 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The signed 64-bit fingerprint of a text."""
    import xxhash

    h64 = xxhash.xxh64_intdigest
    ws = (text or "").encode().lower().split()  # bytes: splits on ASCII white space, lowers A-Z alone
    if not ws:
        return 0
    line = b" ".join(ws)
    if len(ws) <= shingle:
        hs = np.array([h64(line, SEED)], "<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        a = [0, *(ends[: len(ws) - shingle] + 1).tolist()]
        hs = np.fromiter((h64(line[i:j], SEED) for i, j in zip(a, ends[shingle - 1 :].tolist())), "<u8", len(a))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hs), SLICE):
        ones += np.unpackbits(hs[i : i + SLICE].reshape(-1, 1).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hs), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """key, fp (long) of every whole text."""
    kind = df.schema[key].dataType.simpleString()
    return arrow_map(df.select(key, text), lambda c: {key: c[0], "fp": [fingerprint(t, shingle) for t in c[1]]}, f"`{key}` {kind}, fp long")


def shape(rows: int) -> tuple[int, int, int]:
    """(bits of a block, blocks, radius over all bits) for so many rows."""
    import math

    differ = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
    bits = max(16, math.ceil(math.log2(max(rows, 1) / STRANGERS)))
    blocks = math.ceil(math.log(1 - MEET) / math.log(1 - (1 - differ) ** bits))
    total = bits * blocks
    return bits, blocks, round(total * differ + BEYOND * math.sqrt(total * differ * (1 - differ)))


class WideHasher:
    """Wide fingerprints of texts: word shingles hashed by prefix sums modulo 2**64, their bits widened by mixing."""

    def __init__(self, shingle: int, bits: int):
        self.shingle, self.words = shingle, -(-bits // 64)
        self.mask = np.full(8 * self.words, 255, np.uint8)
        self.mask[bits // 8 :] = 0
        if bits % 8:
            self.mask[bits // 8] = (1 << bits % 8) - 1
        self.inv = np.uint64(pow(int(BASE), -1, 1 << 64))
        self.pow = self.neg = np.ones(1, np.uint64)

    def _sums(self, v: np.ndarray) -> np.ndarray:
        n = len(v)
        if len(self.pow) <= n:
            self.pow, self.neg = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(2 * n, b, np.uint64)]) for b in (BASE, self.inv))
        return np.r_[np.uint64(0), np.cumsum(v * self.pow[:n])]

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def __call__(self, text: str | None) -> bytes:
        raw = np.frombuffer((text or "").encode().lower(), np.uint8)
        solid = np.zeros(len(raw) + 2, np.int8)
        solid[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
        step = np.diff(solid)
        a, z = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if not len(a):
            return bytes(8 * self.words)
        sums = self._sums(TABLE[raw])
        ws = self._mix((sums[z] - sums[a]) * self.neg[a])
        sums, w = self._sums(ws), min(self.shingle, len(ws))
        h = self._mix((sums[w:] - sums[:-w]) * self.neg[: len(ws) - w + 1])
        steps = np.arange(1, self.words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        ones = np.zeros(64 * self.words, np.int64)
        for i in range(0, len(h), 255):  # so many bits add up in a byte
            wide = self._mix(h[i : i + 255, None] + steps)
            ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
        return (np.packbits(2 * ones > len(h), bitorder="little") & self.mask).tobytes()


def block_masks(blocks: int, bits: int = 64) -> list[int]:
    edges = [bits * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def agreeing(agree: int, blocks: int) -> list[int]:
    """A signed mask for each choice of `agree` blocks."""
    out = [sum(c) for c in combinations(block_masks(blocks), agree)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def forest(fps: np.ndarray, radius: int, fixed: int = 0) -> list[tuple[int, int]]:
    """Links of a spanning forest of distinct fingerprints at most `radius` bits apart.

    Small sets compare all pairs at once. Larger ones are divided by the same
    pigeonhole rule on radius + 1 blocks of 64 bits, then compared part by part
    in slices, so memory stays bounded by a slice.
    """
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links: list[tuple[int, int]] = []

    def compare(idx: np.ndarray) -> None:
        v = fps[idx]
        for s in range(0, len(v), 1024):
            near = np.bitwise_count(v[s : s + 1024, None] ^ v[None, :]) <= radius
            i, j = np.nonzero(near)
            keep = i + s < j
            for x, y in zip(idx[i[keep] + s].tolist(), idx[j[keep]].tolist()):
                p, q = root(x), root(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    links.append((x, y))

    if len(fps) <= 2048:
        compare(np.arange(len(fps)))
        return links
    free = [m for m in block_masks(64) if not (fixed & m)]
    parts = [sum(free[len(free) * i // (radius + 1) : len(free) * (i + 1) // (radius + 1)]) for i in range(radius + 1)]
    for m in parts:
        k = fps & np.uint64(m)
        order = np.argsort(k, kind="stable")
        starts = np.flatnonzero(np.r_[True, k[order][1:] != k[order][:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(k)]):
            if b - a > 1:
                compare(order[a:b])
    return links


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ over the last axis, the words of fingerprints."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def wide_forest(f: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join wide fingerprints (n, words) at most `radius` bits apart, however many.

    A pivot takes all within the radius; what they can reach beyond it lies
    within twice the radius of the pivot, so only these are compared. A tight
    group of any size goes in one turn; memory stays bounded by a slice.
    """
    links: list[tuple[int, int]] = []
    left = np.arange(len(f))
    while len(left) > 1:
        d = distances(f[left], f[left[0]])
        near, ring = left[d <= radius], left[(d > radius) & (d <= 2 * radius)]
        links += [(int(left[0]), x) for x in near[1:].tolist()]
        step = max(1, (1 << 20) // max(1, len(ring)))
        for s in range(0, len(near) if len(ring) else 0, step):
            hit = (distances(f[near[s : s + step], None], f[None, ring]) <= radius).any(axis=0)
            links += [(int(left[0]), x) for x in ring[hit].tolist()]
            ring = ring[~hit]
            if not len(ring):
                break
        left = left[d > radius]
    return links


def _meet(masks: list[int], radius: int):
    """Sorted (place, choice, fp) rows in; links between fingerprints out."""

    def linked(c: np.ndarray, f: np.ndarray) -> list[tuple[int, int]]:
        out = []
        fixed = masks[int(c[0])] & ((1 << 64) - 1)
        k = f & np.uint64(fixed)
        order = np.argsort(k, kind="stable")
        f, k = f[order], k[order]
        for x in np.split(f, np.flatnonzero(k[1:] != k[:-1]) + 1) if len(f) > 2 else [f]:
            if len(x) > 1:
                out += [(int(x[i]), int(x[j])) for i, j in forest(x, radius, fixed)]
        return out

    def run(it):
        held: tuple[np.ndarray, ...] | None = None

        def done(p, c, f):
            cuts = np.flatnonzero((p[1:] != p[:-1]) | (c[1:] != c[:-1])) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(p)]
            many = np.flatnonzero(ends - starts > 1)
            two = many[(ends - starts)[many] == 2]
            i = starts[two]
            near = np.bitwise_count(f[i] ^ f[i + 1]) <= radius
            a, b = [f[i[near]]], [f[i[near] + 1]]
            more = [x for g in many[(ends - starts)[many] > 2] for x in linked(c[starts[g] : ends[g]], f[starts[g] : ends[g]])]
            if more:
                m = np.array(more, "<u8").reshape(-1, 2)
                a.append(m[:, 0])
                b.append(m[:, 1])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": a.view("<i8"), "b": b.view("<i8")})

        for batch in it:
            if not batch.num_rows:
                continue
            p, c, f = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view("<u8")
            if held is not None:
                p, c, f = (np.concatenate(x) for x in zip(held, (p, c, f)))
            last = len(p) - 1
            same = (p == p[last]) & (c == c[last])
            at = last - int(np.argmin(same[::-1])) + 1 if not same.all() else 0
            held = p[at:], c[at:], f[at:]
            if at:
                yield from done(p[:at], c[:at], f[:at])
        if held is not None:
            yield from done(*held)

    return run


def links(classes: DataFrame, radius: int, blocks: int, agree: int) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column fp."""
    masks = agreeing(agree, blocks)
    choices = F.explode(F.array(*[F.struct(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))).alias("place"), F.lit(i).cast("short").alias("choice")) for i, m in enumerate(masks)]))
    met = classes.select(choices.alias("k"), "fp").select("k.place", "k.choice", "fp").repartition("place").sortWithinPartitions("place", "choice")
    return met.mapInArrow(thrifty(_meet(masks, radius)), "a long, b long")


#: Places up to this size compare their members pair by pair, many places at once.
SMALL = 32


def _deal(bits: int, blocks: int):
    """(rep, fp) rows in; a row per block out: its place, rep, fp."""

    def run(it):
        at_once = 4096 // blocks + 1
        for whole in it:
            for s in range(0, whole.num_rows, at_once):
                batch = whole.slice(s, at_once)
                raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                on = np.unpackbits(raw, axis=1, bitorder="little")[:, : bits * blocks].reshape(-1, blocks, bits)
                value = (on * (np.uint64(1) << np.arange(bits, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
                place = WideHasher._mix(value * np.uint64(blocks) + np.arange(blocks, dtype=np.uint64)).view(np.int64)
                at = pa.array(np.repeat(np.arange(batch.num_rows), blocks))
                yield pa.RecordBatch.from_arrays([pa.array(place.ravel()), batch.column(0).take(at), batch.column(1).take(at)], ["place", "rep", "fp"])

    return run


def _near_pairs(p: np.ndarray, rep: np.ndarray, f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within places (runs of equal p): all pairs of a small place, a spanning forest of a larger one."""
    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    ends = np.r_[starts[1:], len(p)]
    size = ends - starts
    left = np.repeat(ends, size) - np.arange(len(p)) - 1  # members after this one in its place
    left[np.repeat(size > SMALL, size)] = 0
    a, b = [], []
    for d in range(1, int(left.max(initial=0)) + 1):
        i = np.flatnonzero(left >= d)
        i = i[distances(f[i], f[i + d]) <= radius]
        a.append(rep[i])
        b.append(rep[i + d])
    for s, e in zip(starts[size > SMALL].tolist(), ends[size > SMALL].tolist()):
        got = wide_forest(f[s:e], radius)
        if got:
            i, j = np.array(got).T
            a.append(rep[s + i])
            b.append(rep[s + j])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _meet_wide(radius: int):
    """Rows (place, rep, fp) sorted by place in; links between reps out."""

    def run(it):
        held = None
        for batch in it:
            if not batch.num_rows:
                continue
            p, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            f = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(len(p), -1)
            if held is not None:
                p, rep, f = (np.concatenate(x) for x in zip(held, (p, rep, f)))
            at = int(np.searchsorted(p, p[-1]))
            held = p[at:], rep[at:], f[at:]
            if at:
                a, b = _near_pairs(p[:at], rep[:at], f[:at], radius)
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": a, "b": b})
        if held is not None:
            a, b = _near_pairs(*held, radius)
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return run


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, blocks: int = 5) -> DataFrame:
    """key, fp, component_id (smallest key reachable) for every row: every link is found."""
    d = cut(fingerprints(df, key, text, shingle))
    classes = cut(d.groupBy("fp").agg(F.min(key).alias("rep")))
    roots = components(links(classes, radius, blocks, blocks - radius))
    of = cut(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    # written, so that a root of very many classes is split at the join
    least = cut(of.groupBy("root").agg(F.min("rep").alias("component_id")))
    member = cut(of.join(least, "root").select("fp", "component_id"))
    return d.join(member, "fp")


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near(df: DataFrame, row: str, text: str = "text", shingle: int = 5) -> DataFrame:
    """row, root for the rows of every component of near copies (or copies): one root, a row of the component, each; lone rows are left out.

    `row` must tell rows apart. Fingerprints are as wide as `shape` says for
    the number of rows; equal ones are one class before any of them is dealt.
    """
    bits, blocks, radius = shape(df.count())

    def of(c: list[list]) -> dict[str, list]:
        hasher = WideHasher(shingle, bits * blocks)
        return {"row": c[0], "fp": [hasher(t) for t in c[1]]}

    d = cut(arrow_map(df.select(row, text), of, "row long, fp binary"))
    classes = cut(d.groupBy("fp").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n")))
    dealt = classes.select("rep", "fp").mapInArrow(thrifty(_deal(bits, blocks)), "place long, rep long, fp binary")
    met = dealt.repartition("place").sortWithinPartitions("place").mapInArrow(thrifty(_meet_wide(radius)), "a long, b long")
    roots = components(met)
    of_class = cut(classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").filter("n > 1 OR root IS NOT NULL").select("fp", F.coalesce("root", "rep").alias("root")))
    return d.join(of_class, "fp").select(F.col("row").alias(row), "root")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """All columns of one row of each component: that of the smallest key, null last.

    Rows are told apart by an id of their own, so null and repeated keys are
    rows like any other; of equal keys the row of the smallest hash over all
    columns stays.
    """
    row = free(df, "row")
    d = cut(df.withColumn(row, F.monotonically_increasing_id()))
    first = F.struct(F.col(key).isNull(), F.col(key), F.xxhash64(*df.columns), F.col(row).alias("row"))
    of = cut(near(d.select(row, text), row, text, shingle).join(d.select(row, first.alias("first")), row).select("root", "first"))
    stay = of.groupBy("root").agg(F.min("first").alias("first"))
    go = cut(of.select(F.col("first.row").alias(row)).join(stay.select(F.col("first.row").alias(row)), row, "left_anti"))
    return d.join(go, row, "left_anti").select(*df.columns)
