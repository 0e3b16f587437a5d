"""Two-pass external shuffle into shards, on DataFrame functions alone.

Pass one scatters records into memory-sized buckets by a seeded hash; pass two
Fisher-Yates shuffles each bucket. Bucket offsets come from a two-level prefix
sum, so each shard's slots are gapless without sorting a shard in one task.
Equal records are counted before the scatter and scattered in lots of LOT, so
any number of them spreads over the buckets like other rows.

Law `key`: the shard is the rendezvous (highest random weight) choice over the
key, so one more shard takes rows only into itself.

Null keys hash like any value; null text has no bytes; rows that repeat keep
their own slots; extra columns are carried by `write_shards`; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, exclusive_offsets

SEED = 20_731
#: Aims for a bucket: what one task holds and shuffles.
BUCKET_ROWS = 4_096
BUCKET_BYTES = 64 << 20
#: Equal records that go to one bucket together.
LOT = 64


def rendezvous(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash of the key is highest."""
    tries = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("w"), F.lit(i).alias("i")) for i in range(shards)]
    return F.array_max(F.array(*tries))["i"]


def fisher_yates(n: Column, *salt: Column, seed: int = SEED) -> Column:
    """A permutation of 0..n-1: for i from n-1 down, swap i with a seeded random j <= i.

    The array is held as bytes, four an entry, so that a swap is two block
    copies and costs no evaluation per entry.
    """
    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    entry = lambda a, i: F.substring(a, i * 4 + 1, F.lit(4))

    def swap(a: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), *salt, i), i + 1).cast("int")
        return F.overlay(F.overlay(a, entry(a, j), i * 4 + 1), entry(a, i), j * 4 + 1)

    every = F.sequence(F.lit(0), n - 1)
    start = F.unhex(F.array_join(F.transform(every, lambda i: F.lpad(F.hex(i), 8, "0")), ""))
    done = F.aggregate(steps, start, swap)
    # a let-binding: the finished bytes are one value, however many entries are read from it
    return F.when(n > 0, F.element_at(F.transform(F.array(done), lambda b: F.transform(every, lambda i: F.conv(F.hex(entry(b, i)), 16, 10).cast("int"))), 1))


def _records(df: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(df[text], F.lit(""))
    return df.select(df[key].alias("_key"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))


def _placed(d: DataFrame, shards: int, seed: int, bucket_rows: int, bucket_bytes: int) -> DataFrame:
    """_key, size, text_crc32, copy (place among equal records), shard, slot, grown_shard from `_records`."""
    same = cut(d.groupBy("_key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")))
    rows, total = same.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0))).first()
    buckets = max(1, math.ceil(rows / shards / bucket_rows), math.ceil(total / shards / bucket_bytes))
    lots = same.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {LOT}"))))
    lots = lots.withColumns({"shard": rendezvous(F.col("_key"), shards, seed), "grown_shard": rendezvous(F.col("_key"), shards + 1, seed), "bucket": F.pmod(F.xxhash64(F.lit(seed + 1), "_key", "size", "text_crc32", "lot"), F.lit(buckets)).cast("long"), "m": F.least(F.lit(LOT), F.col("n") - F.col("lot") * LOT).cast("int")})
    lot = F.struct(F.xxhash64(F.lit(seed + 2), "_key", "text_crc32", "lot").alias("h"), "_key", "size", "text_crc32", "grown_shard", "lot", "m")
    g = lots.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list(lot)).alias("lots"), F.sum("m").cast("int").alias("n"))
    one = lambda x, i: F.struct(x["_key"].alias("_key"), x["size"].alias("size"), x["text_crc32"].alias("text_crc32"), x["grown_shard"].alias("grown_shard"), (x["lot"] * LOT + i).alias("copy"))
    g = cut(g.withColumn("recs", F.flatten(F.transform("lots", lambda x: F.transform(F.sequence(F.lit(0), x["m"] - 1), lambda i: one(x, i))))).drop("lots"))
    at = exclusive_offsets(g.select("shard", "bucket", "n"), ["shard"], "bucket", "n", "base").drop("n")
    perm = fisher_yates(F.col("n"), F.col("shard"), F.col("bucket"), seed=seed)
    s = g.join(at, ["shard", "bucket"]).withColumn("recs", F.transform(perm, lambda i: F.get("recs", i)))
    return s.select("shard", "base", F.posexplode("recs").alias("pos", "r")).select("r.*", "shard", (F.col("base") + F.col("pos")).alias("slot"))


def placements(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """A row per record: key, size, text_crc32, shard, slot, grown_shard."""
    p = _placed(_records(df, key, text), shards, seed, bucket_rows, bucket_bytes)
    return p.select(F.col("_key").alias(key), "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the records themselves and their slots, one folder `shard=N` per shard, each file a run of shuffled buckets.

    Every record takes the slot that `placements` gives it; those with equal
    key, size and checksum are numbered by two-level prefix sums, not in one
    task, and take each other's slots in the order of that number. All columns
    are carried in a struct, so none can clash; files hold them under their own
    names, and `shard` and `slot` get underscores until they clash with none.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    d = cut(df.select(whole.alias("row"), F.monotonically_increasing_id().alias("m")))
    r = _records(d.select("m", F.col("row")[key].alias("k"), F.col("row")[text].alias("t")), "k", "t")
    same = ["_k", "size", "text_crc32"]
    body = F.coalesce(F.col("row")[text], F.lit(""))
    d = d.select("row", "m", F.xxhash64(F.lit(seed), F.col("row")[key]).alias("_k"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    d = d.withColumn("part", F.expr(f"m div {BUCKET_ROWS}"))
    at = exclusive_offsets(d.groupBy(*same, "part").agg(F.count(F.lit(1)).alias("n")), same, "part", "n", "base").drop("n")
    d = d.join(at, [*same, "part"]).withColumn("copy", F.col("base") + F.row_number().over(W.partitionBy(*same, "part").orderBy("m")) - 1)
    p = _placed(r, shards, seed, bucket_rows, bucket_bytes).withColumn("_k", F.xxhash64(F.lit(seed), "_key"))
    shard, slot = "shard", "slot"
    while {shard, slot} & set(df.columns):
        shard, slot = f"{shard}_", f"{slot}_"
    out = d.join(p, [*same, "copy"]).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    out.select(F.col("shard").alias(shard), F.col("slot").alias(slot), "row.*").write.partitionBy(shard).parquet(path)
