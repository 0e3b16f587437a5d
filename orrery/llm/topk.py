"""Exact top-k by inner product: distributed histogram selection.

Vectors are packed into blocks of fixed size; every query block meets every
candidate block (a stated query set against all rows, in blocks). A round
scores everything and counts, per query, the scores in BINS equal bins; the
bins' sums over all blocks show the bin of the k-th highest score, whose bounds
are the next round's range. When ranges are one score wide, each query's k-th
value is known exactly. A last pass emits scores at or above it - from each
block no more than its own k best - and ties break on the smaller id.

Rows are told apart by an id of their own, so rows of equal vec_id are each
other's candidates and each a query of its own. Null vectors and vectors
holding null or non-finite values take no part, nor do rows of null vec_id,
vectors of another length than the query's, or vectors so long that a score
may not fit a long (squared length of the scaled vector above 2**62). Repeated
vectors tie; fewer than k candidates give all of them; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

BINS = 512
#: Candidates of a block: every query block is sent to each, so blocks are as large as memory allows (8 MB at 128 dimensions).
BLOCK = 16_384
LEAST_BLOCK = 256
QUERY_BLOCK = 128
#: Counts of a query block meet in two steps, first in so many places.
SALTS = 32


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """id, v (floor(scale * x) of each component), row (an id of the row), and `query` if df has it; unfit rows left out."""
    x = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    fit = F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.forall("x", lambda x: F.abs(x) < 2.0**31) & (F.aggregate("x", F.lit(0.0), lambda a, x: a + (F.abs(x) + 1) * (F.abs(x) + 1)) < 2.0**62)
    d = df.filter(fit).select(F.col(key).cast("long").alias("id"), x.alias("x"), F.monotonically_increasing_id().alias("row"), "query")
    # the guard stands in the expression itself: filters may be evaluated after it
    whole = F.transform("x", lambda x: F.when(F.abs(x) < 2.0**31, F.floor(x)).cast("long"))
    return d.filter(small).select("id", whole.alias("v"), "row", "query")


def blocks(q: DataFrame, size: int, rows: int) -> DataFrame:
    """Vectors of one length packed by a hash of their row: dim, block, ids, rows, vs (little-endian, 32 bits a component)."""
    n = max(1, -(-rows // size))
    schema = "dim int, block long, ids binary, rows binary, vs binary"
    keyed = q.select("id", "v", "row", F.size("v").alias("dim"), F.pmod(F.xxhash64(F.lit(11), "row"), F.lit(n)).cast("long").alias("block"))

    def pack(table: pa.Table) -> pa.Table:
        ids, row = table["id"].to_numpy(), table["row"].to_numpy()
        flat = table["v"].combine_chunks().flatten().to_numpy()
        order = np.lexsort((row, ids))
        vs = flat.reshape(len(ids), -1)[order].astype("<i4").tobytes()
        return pa.table({"dim": pa.array([len(flat) // len(ids)], pa.int32()), "block": pa.array([table["block"][0].as_py()], pa.int64()), "ids": [ids[order].astype("<i8").tobytes()], "rows": [row[order].astype("<i8").tobytes()], "vs": [vs]})

    return keyed.groupBy("dim", "block").applyInArrow(pack, schema)


def _scores(qs: bytes, cs: bytes, dim: int) -> np.ndarray:
    """Integer inner products; float64 is exact while every sum stays under 2**53."""
    a, b = np.frombuffer(qs, "<i4").reshape(-1, dim).astype(float), np.frombuffer(cs, "<i4").reshape(-1, dim).astype(float)
    top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * dim
    return (a @ b.T).astype(np.int64) if top < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


def _counts(it):
    """Per query block, counts of scores by bin of each query's range, summed over the task's candidate blocks."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in it:
        for r in batch.to_pylist():
            s = _scores(r["qvs"], r["cvs"], r["dim"])
            qid, cid = np.frombuffer(r["qrows"], "<i8"), np.frombuffer(r["crows"], "<i8")
            lo, step = np.frombuffer(r["lo"], "<i8"), np.frombuffer(r["step"], "<i8")
            b = (s - lo[:, None]) // step[:, None]
            b[qid[:, None] == cid[None, :]] = -1
            b = np.minimum(b, BINS)  # above the range: counted in one bin
            b += np.where(b >= 0, np.arange(len(qid))[:, None] * (BINS + 1), 0)
            one = np.bincount(b[b >= 0], minlength=len(qid) * (BINS + 1))
            at = r["dim"], r["qblock"]
            sums[at] = sums[at] + one if at in sums else one
            if len(sums) > 64:
                yield from _emit(sums)
                sums.clear()
    yield from _emit(sums)


def _emit(sums):
    import zlib

    for (dim, qblock), v in sums.items():
        salt = zlib.crc32(v[: 64 * BINS].tobytes()) % SALTS
        yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "qblock": pa.array([qblock], pa.int64()), "salt": pa.array([salt], pa.int32()), "counts": [v.astype("<i8").tobytes()]})


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_py(), "<i8") for c in table["counts"])
    return pa.table({"dim": table["dim"][:1], "qblock": table["qblock"][:1], "counts": [total.tobytes()]})


def _narrow(k: int):
    """Sum a query block's counts and find each query's bin of its k-th score."""

    def run(table: pa.Table) -> pa.Table:
        lo, step = np.frombuffer(table["lo"][0].as_py(), "<i8"), np.frombuffer(table["step"][0].as_py(), "<i8")
        total = np.zeros((len(lo), BINS + 1), np.int64)
        for c in table["counts"]:
            total += np.frombuffer(c.as_py(), "<i8").reshape(len(lo), BINS + 1)
        at_least = total[:, ::-1].cumsum(axis=1)[:, ::-1]  # scores in this bin or above
        bins = np.where((at_least >= k).any(axis=1), BINS - (at_least >= k)[:, ::-1].argmax(axis=1), 0)
        lo = lo + np.minimum(bins, BINS - 1) * step
        return pa.table({"dim": table["dim"][:1], "qblock": table["qblock"][:1], "lo": [lo.astype("<i8").tobytes()], "step": [np.maximum(-(-step // BINS), 1).astype("<i8").tobytes()]})

    return run


def _best(k: int):
    """Per query, the block's scores at or above the k-th value: its own k best at most."""

    def run(it):
        for batch in it:
            for r in batch.to_pylist():
                s = _scores(r["qvs"], r["cvs"], r["dim"])
                qid, cid, lo, qrow, crow = (np.frombuffer(r[c], "<i8") for c in ("qids", "cids", "lo", "qrows", "crows"))
                ok = (s >= lo[:, None]) & (qrow[:, None] != crow[None, :])
                i, j = np.nonzero(ok)
                if len(i):
                    order = np.lexsort((cid[j], -s[i, j], i))
                    i, j = i[order], j[order]
                    rank = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j = i[rank < k], j[rank < k]
                    yield pa.RecordBatch.from_pydict({"query_id": qid[i], "query_row": qrow[i], "vec_id": cid[j], "vec_row": crow[j], "score": s[i, j]})

    return run


def top_k(df: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each row that `queries` selects, its own row left out."""
    fit = cut(quantised(df.select(key, vector, F.coalesce(queries, F.lit(False)).alias("query")), key, vector))
    asked = fit.filter("query")
    # a bound of every score, by Cauchy-Schwarz, from the longest vector
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    rows, n_queries, top = fit.agg(F.count(F.lit(1)), F.count_if("query"), F.coalesce(F.max(size), F.lit(0.0))).first()
    block = block or min(BLOCK, max(LEAST_BLOCK, -(-rows // 64)))
    packed = lambda d, size, n, as_: cut(blocks(d, size, n)).select("dim", *[F.col(c).alias(f"{as_}{c}") for c in ("block", "ids", "rows", "vs")])
    c, q = packed(fit, block, rows, "c"), packed(asked, query_block, n_queries, "q")
    bound = int(top) + 1
    step = max(1, -(-(2 * bound + 1) // BINS))

    def start(it):
        for batch in it:
            for r in batch.to_pylist():
                n = len(r["qids"]) // 8
                yield pa.RecordBatch.from_pydict({"dim": pa.array([r["dim"]], pa.int32()), "qblock": pa.array([r["qblock"]], pa.int64()), "lo": [np.full(n, -bound, "<i8").tobytes()], "step": [np.full(n, step, "<i8").tobytes()]})

    ranges = q.mapInArrow(start, "dim int, qblock long, lo binary, step binary")
    n_blocks = max(1, -(-rows // block))

    def pairs(ranges: DataFrame) -> DataFrame:
        """Every query block beside every candidate block, dealt by candidate block."""
        r = q.join(ranges, ["dim", "qblock"]).withColumn("cblock", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
        return r.join(c, ["dim", "cblock"])

    width = step
    while True:
        counted = pairs(ranges).mapInArrow(_counts, "dim int, qblock long, salt int, counts binary")
        summed = counted.groupBy("dim", "qblock", "salt").applyInArrow(_add, "dim int, qblock long, counts binary")
        ranges = cut(summed.join(ranges, ["dim", "qblock"]).groupBy("dim", "qblock").applyInArrow(_narrow(k), "dim int, qblock long, lo binary, step binary"))
        if width <= 1:
            break
        width = -(-width // BINS)
    found = pairs(ranges).mapInArrow(_best(k), "query_id long, query_row long, vec_id long, vec_row long, score long")
    best = W.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id", "vec_row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
