"""The subpackage's queries: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, licences, mixing, packing, pii, quality, sharding, simhash, suffix, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sharding.placements(_table(spark, sf_dir, "documents"), shards=8)
    return p.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    dictionaries = langid.learn(d.filter(~langid.held_out(F.col("doc_id"))))
    return langid.predict(d, dictionaries).withColumn("held_out", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = simhash.assign(_table(spark, sf_dir, "documents"), shingle=3, radius=2, blocks=5)
    return a.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = mixing.mix(_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicated(_table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import cut

    p = cut(packing.pieces(_table(spark, sf_dir, "documents"), tokenizer()))
    return packing.pack(p).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_sharding, op3_quality, op4_langid, op5_topk, op6_simhash, op7_mixing, op8_suffix, op9_licences, op10_packing)}


#: Only where SQL expresses the whole result.
ORACLE_SQL = {
    "op5_topk": """
WITH fit AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.n AS qn, c.vec_id, c.n, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM fit q JOIN fit c ON c.n <> q.n WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY qn ORDER BY score DESC, vec_id, n) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
