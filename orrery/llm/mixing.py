"""Mixing sources to target weights with a low-discrepancy schedule.

Slot i of the mix goes to the source whose share of the unit interval holds
the point frac(i / golden ratio). Slots are ranked per source; the r-th slot of
a source takes its r-th block of BLOCK words from the source's documents laid
end to end in seeded-hash order, going round again after the last. A source's
stream is cut at its target, so what it takes equals the target's whole part.

Targets share 150 % of all words by weight, each at most twice its source's
size, what is over being shared anew by weight among the rest (water-filling).

Null text has no words; a null source is a source of its own, last in order;
documents without words take nothing; repeated rows each hold their own place;
an empty table gives an empty result. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, cut, exclusive_offsets, running, words

BLOCK = 2_048
SEED = 97
WEIGHTS = (3, 1, 2)
EPOCHS = 1.5
CAP = 2.0
GOLDEN = 0.6180339887498949
#: Documents laid end to end are bucketed by hash so that a bucket holds so many rows of the largest source.
BUCKET_ROWS = 64
SLOT_BLOCK = 64


def targets(sizes: DataFrame, epochs: float = EPOCHS, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, weight, target from (source, source_size): a row per source.

    The level at which all sources share the rest rises until no source below
    it passes its cap: each turn is one sum over the sources, and at least one
    more source is capped.
    """
    n = running(sizes, [F.col("source").isNull(), F.col("source")], F.lit(1), "_n")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_n"), F.lit(len(weights))) + 1).cast("int"))
    t = cut(n.select("source", F.col("source_size").cast("long").alias("source_size"), w.alias("weight")))
    top = F.col("source_size") * cap
    level, total = -1.0, epochs * (t.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        over = top < level * F.col("weight")
        capped, rest = t.agg(F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        risen = (total - cap * capped) / rest if rest else float("inf")
        if risen <= level or not rest:
            break
        level = risen
    return t.withColumn("target", F.least(top.cast("double"), F.lit(level) * F.col("weight")))


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, skey, rank, words: the mix, slot by slot; plan has skey and quota (words to take) per source."""
    spark = plan.sparkSession
    p = plan.filter("quota > 0").withColumn("_need", F.ceil(F.col("quota") / block))
    total = p.agg(F.sum("_need")).first()[0] or 0
    # every range is dealt against the sources' shares of the unit interval
    p = running(p, [F.col("skey")], F.col("_need"), "_c").withColumns({"_hi": (F.col("_c") + F.col("_need")) / max(total, 1), "_lo": F.col("_c") / max(total, 1)}).drop("_c")
    bounds = cut(p)
    # the interval of a point is found through a grid: each source lists the cells it touches
    cells = 4096
    grid = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("_lo") * cells), F.least(F.floor(F.col("_hi") * cells), F.lit(cells - 1)))))
    point = F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0))
    slots = spark.range(total).withColumn("point", point).withColumn("cell", F.floor(F.col("point") * cells))
    hit = slots.join(F.broadcast(grid) if grid.count() <= 2 * cells else grid, "cell").filter((F.col("point") >= F.col("_lo")) & (F.col("point") < F.col("_hi"))).select("id", "skey")
    blk = F.floor(F.col("id") / SLOT_BLOCK)
    hit = cut(hit.withColumn("sblk", blk))
    count = hit.groupBy("skey", "sblk").agg(F.count(F.lit(1)).alias("n"))
    base = exclusive_offsets(count, ["skey"], "sblk", "n", "base").drop("n")
    ranked = hit.withColumn("_r", F.row_number().over(W.partitionBy("skey", "sblk").orderBy("id")) - 1).join(base, ["skey", "sblk"]).select("skey", "id", (F.col("base") + F.col("_r")).alias("rank"))
    # the points of a source fall short of its need by a few at most: those follow at the end
    got = count.groupBy("skey").agg(F.sum("n").alias("_got"))
    short = bounds.join(got, "skey", "left").withColumn("_got", F.coalesce("_got", F.lit(0))).filter("_got < _need")
    tail = short.select("skey", F.explode(F.sequence(F.col("_got"), F.col("_need") - 1)).alias("rank")).withColumn("id", F.lit(total) + F.xxhash64("rank").bitwiseAND(F.lit((1 << 40) - 1)))
    every = ranked.unionByName(tail.select("skey", "id", "rank")).join(bounds.select("skey", "quota", "_need"), "skey").filter("rank < _need")
    return every.select(F.col("id").alias("slot"), "skey", "rank", F.least(F.lit(block), F.col("quota") - F.col("rank") * block).cast("long").alias("words"))


def lines(d: DataFrame, rows: int) -> DataFrame:
    """Add `start`: each document's place on its source's line, in seeded-hash order."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    d = d.withColumn("bucket", F.floor(F.pmod(F.col("h"), F.lit(1 << 40)) / float(1 << 40) * buckets).cast("long"))
    sums = d.groupBy("skey", "bucket").agg(F.sum("size").alias("n"))
    at = exclusive_offsets(sums, ["skey"], "bucket", "n", "base").drop("n")
    inner = W.partitionBy("skey", "bucket").orderBy("h", "_key", "size", "_row").rowsBetween(W.unboundedPreceding, -1)
    return d.withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(at, ["skey", "bucket"]).withColumn("start", F.col("base") + F.col("_in")).drop("bucket", "_in", "base")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = SEED, epochs: float = EPOCHS, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, slots).

    documents: key, source, size, source_size, target, taken, and start, the
    document's place on its source's line, and the column `row`, if given, that
    tells rows of equal key apart. slots: slot, source, rank, words.
    """
    body = F.coalesce(df[text], F.lit(""))
    d = df.select(df[key].alias("_key"), df[source].cast("string").alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), df[key], F.crc32(F.encode(body, "UTF-8"))).alias("h"), (F.lit(0) if row is None else df[row]).alias("_row"))
    d = cut(d.withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))))
    rows = d.count()
    plan = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), epochs, cap, weights)
    plan = cut(plan.withColumns({"skey": F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")), "quota": F.floor(F.col("target") + 1e-6).cast("long")}))
    slots = cut(schedule(plan, block))
    laid = cut(lines(d, rows).join(plan.select("skey", "source_size", "target"), "skey"))
    # a slot covers words [rank * block, + words) of a stream that repeats its source's line; cut it where the line ends
    s = slots.join(plan.select("skey", "source_size"), "skey").withColumn("a", F.col("rank") * block).withColumn("b", F.col("a") + F.col("words"))
    turns = F.explode(F.sequence(F.expr("a div source_size"), F.expr("(b - 1) div source_size")))
    s = s.withColumn("turn", turns).select("skey", F.greatest(F.col("a") - F.col("turn") * F.col("source_size"), F.lit(0)).alias("a"), F.least(F.col("b") - F.col("turn") * F.col("source_size"), "source_size").alias("b"))
    # both sides are cut at the same marks on the line, so slots and documents meet by equality
    cell = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div {block}"), F.expr(f"({b} - 1) div {block}")))
    s = s.withColumn("cell", cell("a", "b")).select("skey", "cell", "a", "b")
    p = laid.filter("size > 0").withColumn("end", F.col("start") + F.col("size")).withColumn("cell", cell("start", "end")).select("skey", "cell", "_key", "h", "start", "end")
    low, high = F.greatest("a", "start", F.col("cell") * block), F.least("b", "end", (F.col("cell") + 1) * block)
    took = p.join(s, ["skey", "cell"]).withColumn("w", high - low).filter("w > 0").groupBy("skey", "start", "end").agg(F.sum("w").alias("taken"))
    out = laid.withColumn("end", F.col("start") + F.col("size")).join(took, ["skey", "start", "end"], "left")
    docs = out.select(F.col("_key").alias(key), "source", "h", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"), "start", *([] if row is None else [F.col("_row").alias(row)]))
    return docs, slots.join(plan.select("skey", "source"), "skey").select("slot", "source", "rank", "words")


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The documents of the mix, all columns: a row per document and turn it is taken.

    A document that its source's target cuts through keeps, in that last turn,
    the words before the cut, single spaces between. Rows are told apart by an
    id of their own, so null and repeated keys are rows like any other.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    d = cut(df.select(whole.alias("all"), F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"), F.struct(F.xxhash64(*df.columns).alias("h"), F.monotonically_increasing_id().alias("i")).alias("row")))
    docs, _ = mix(d, "key", "text", "source", row="row", **how)
    t = docs.filter("taken > 0").select("row", "size", "taken")
    turns = F.explode(F.sequence(F.lit(0), F.expr("(taken - 1) div size")))
    t = t.withColumn("turn", turns).withColumn("words", F.least("size", F.col("taken") - F.col("turn") * F.col("size")))
    part = F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("words").cast("int")), " ")
    out = d.join(t, "row").withColumn("text", F.when(F.col("words") < F.col("size"), part).otherwise(F.col("text")))
    return out.select(*[F.col("text" if c == text else f"all.`{c}`").alias(c) for c in df.columns])
