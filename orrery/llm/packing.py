"""Best-fit packing of tokenised documents into fixed-length sequences.

Each document becomes token ids plus an end id. Documents longer than a
sequence are cut into full pieces and a rest. Pieces are dealt into groups by a
seeded hash; in a group they go, longest first, to the open sequence that fits
best under three capacities at once: residual tokens, documents and attention
cost (the sum of squared lengths). A sequence qualifies only if it can hold the
piece under every capacity; among those, the one with the highest weighted dot
product of piece and residual, or the smallest residual norm, is taken.

Null text is empty: it has the end id alone. Repeated rows are packed each;
texts of any length are tokenised whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, small_batches, thrifty

LENGTH = 4_096
END_ID = 1
#: Pieces packed together in one task; a group leaves about half a sequence open.
GROUP = 6_000
#: Word stems remembered by a worker.
REMEMBER = 100_000

#: A line's stem and what follows it; two empty groups for a line of another make. ß and ÿ have no one-letter upper case here.
_PLAIN = re.compile(r"(?m)^(?:([a-zà-öø-ÿ]*[a-zà-öø-þ])(?<!ß)([.,!?;:|#$%&*=()\"-]*)$|[^\n]*$)")


class WordEncoder:
    """Token ids of words by a public word-level BPE vocabulary, as little-endian uint32 bytes.

    The vocabulary's pre-tokenizer never joins what white space parts, so a
    text's ids are its words' ids in a row. The distinct words of a portion are
    looked up together: plain ones take a byte-pair merge by rank in tiktoken, where a
    word's last letter is marked by its upper-case form, which stands for the
    vocabulary's word-end symbol. All others go through `tokenizers` itself.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self._merger(json.load(f)["model"]["vocab"])
        self.stems: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {"": b""}

    def _merger(self, vocab: dict[str, int]) -> None:
        import tiktoken

        # the byte-level alphabet: printable Latin-1 stands for itself, the rest follow from U+0100
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        inner = {*range(97, 123), 0xC3, *range(0xA0, 0xC0)} - {0xB7}
        ranks = {}
        self.final = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            body = token.removesuffix("</w>")
            raw = bytes(back[c] for c in body) if all(c in back for c in body) else b""
            if not raw or not inner.issuperset(raw) or token != body and raw[-1] == 0xC3:
                continue
            if token != body:
                raw = raw[:-1] + bytes([raw[-1] - 32])
                self.final[i] = True
            ranks[raw] = i
        self.merge = tiktoken.Encoding("words", pat_str="[a-zà-ÿ]*[A-ZÀ-ß]", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words without ASCII white space."""
        stems, ends = self.stems, self.ends
        if len(stems) > REMEMBER:
            stems.clear()
        if len(ends) > REMEMBER:
            ends = self.ends = {"": b""}
        parts = _PLAIN.findall(b"\n".join(words).decode().lower())
        new = [x for x in {p[0] for p in parts} if x and x not in stems]
        if new:
            ids = np.array(self.merge("".join([x[:-1] + x[-1].upper() for x in new])), np.int64)
            cuts = [0, *(4 * (np.flatnonzero(self.final[ids]) + 1)).tolist()]
            raw = ids.astype("<u4").tobytes()
            stems.update(zip(new, [raw[i:j] for i, j in zip(cuts, cuts[1:])], strict=True))
        for end in {p[1] for p in parts} - ends.keys():
            ends[end] = self.whole(end)
        return [stems[stem] + ends[end] if stem else self.whole(w.decode()) if w else b"" for w, (stem, end) in zip(words, parts, strict=True)]

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a string array; some megabytes of text at a time is enough.

        The vocabulary is lower-case, so ASCII letters are lowered at once,
        except where that might make a special token's string.
        """
        texts = pc.fill_null(texts, "")
        marked = pc.match_substring(texts, "<|")
        low = pc.ascii_lower(texts)
        if pc.any(marked).as_py():
            low = pc.if_else(marked, texts, low)
        lists = pc.ascii_split_whitespace(low)
        coded = lists.flatten().dictionary_encode()
        known = self.words(coded.dictionary.cast(pa.binary()).to_pylist()) if len(coded.dictionary) else []
        taken = pa.array(known, pa.large_binary()).take(coded.indices)
        at = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        at = at[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        data = taken.buffers()[2] if len(taken) else None
        data = memoryview(data) if data is not None else b""
        return [bytes(data[i:j]) for i, j in zip(at, at[1:])]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary, kept from task to task."""
    import sys
    import types

    kept = sys.modules.setdefault("_orrery_worker", types.ModuleType("_orrery_worker")).__dict__
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def _portions(texts: pa.Array, size: int = 4_000_000):
    """Slices (offset, texts) of about `size` bytes together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, size + (ends[a - 1] if a else 0), "right")))
        yield a, texts.slice(a, b - a)
        a = b


def pieces(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """key, piece, start, length, ids_crc32 and ids (little-endian uint32) of every document's pieces."""
    small_batches(df.sparkSession)
    end = array("I", [end_id]).tobytes()

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            keys = b.column(0).to_pylist()
            for x, texts in _portions(b.column(1)):
                out = {c: [] for c in (key, "piece", "start", "length", "ids_crc32", "ids")}
                for k, raw in zip(keys[x : x + len(texts)], enc.ids(texts)):
                    raw += end
                    for i, s in enumerate(range(0, len(raw), 4 * length)):
                        part = raw[s : s + 4 * length]
                        for c, v in zip(out, (k, i, s // 4, len(part) // 4, zlib.crc32(part), part)):
                            out[c].append(v)
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(key, b.schema.field(0).type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]))

    return df.select(key, text).mapInArrow(thrifty(run), f"`{key}` {df.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, ids binary")


def best_fit(lengths: np.ndarray, capacity: int = LENGTH, max_docs: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, packed longest first under every capacity.

    max_docs and max_attention default to what `capacity` implies, so they
    bind only when set lower. rule "norm" takes the bin of the smallest
    weighted residual norm after the piece; "dot" the highest weighted dot
    product of the piece with the residual, both in shares of the capacities.
    """
    caps = np.array([capacity, max_docs or capacity, max_attention or capacity * capacity], float)
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.lexsort((np.arange(n), -lengths))
    free = np.zeros((3, max(n, 1)))  # residuals of open bins
    used = np.zeros(max(n, 1), np.int64)
    live = np.zeros(0, np.int64)  # bins that can still take the smallest piece
    made, least = 0, float(lengths.min()) if n else 0.0
    w = np.array(weights) / caps
    for i in order.tolist():
        size = int(lengths[i])
        need = (size, 1.0, float(size) * size)
        at = -1
        if size < capacity and len(live):
            f = free[:, live]
            ok = (f[0] >= need[0]) & (f[1] >= need[1]) & (f[2] >= need[2])
            if ok.any():
                if rule == "dot":
                    score = (f[0] * need[0] * w[0] ** 2 + f[1] * need[1] * w[1] ** 2 + f[2] * need[2] * w[2] ** 2) * -1.0
                else:
                    score = ((f[0] - need[0]) * w[0]) ** 2 + ((f[1] - need[1]) * w[1]) ** 2 + ((f[2] - need[2]) * w[2]) ** 2
                score[~ok] = np.inf
                at = int(live[score.argmin()])
        if at < 0:
            at = made
            made += 1
            free[:, at] = caps
            live = np.append(live, at)
        bins[i], offsets[i] = at, used[at]
        used[at] += size
        free[:, at] -= need
        if free[0, at] < least or free[1, at] < 1 or free[2, at] < least * least:
            live = live[live != at]
    return bins, offsets


def pack(p: DataFrame, length: int = LENGTH, group: int = GROUP, seed: int = 5, **how) -> DataFrame:
    """Add sequence_id and offset to pieces, whose other columns (their ids) go along."""
    rows = p.count()
    groups = max(1, -(-rows // group))
    keyed = p.withColumn("_g", F.pmod(F.xxhash64(F.lit(seed), *[c for c in p.columns if c != "ids"]), F.lit(groups)).cast("long"))
    names = p.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema) + ", sequence_id long, offset long"

    def run(table: pa.Table) -> pa.Table:
        # rows come in any order: sort them, so that a task run again gives the same bins
        table = table.sort_by([(c, "ascending") for c in names])
        bins, offsets = best_fit(table["length"].to_numpy(), length, **how)
        return table.select(names).append_column("sequence_id", pa.array((table["_g"][0].as_py() << 24) + bins, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return keyed.groupBy("_g").applyInArrow(run, schema)
