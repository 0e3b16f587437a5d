"""A training-data pipeline of five stages over `documents`.

Language ID, SimHash near-dedup, personal data, source mixing, packing. Every
stage works on all its predecessor kept and is written as Parquet before the
next one reads it; all but the last return the columns of `documents`.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import langid, mixing, packing, pii, simhash
from orrery.llm.common import cut, remove, shared_dir, tracked
from orrery.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a clear language stay, `lang` set to it."""
    d = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.accepted(docs, d).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies stays."""
    return simhash.deduplicated(docs).select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows."""
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and turn that the mix takes it; n_chars follows."""
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces, their token ids with them, and their sequence and place."""
    return packing.pack(cut(packing.pieces(docs, tokenizer())))


_spent: dict[str, list[str]] = {}


def _swept(stage):
    """A stage that first deletes what the stage before left in the shared folder.

    A stage's result is written and reread before the next one begins, so the
    tables behind it are spent by then. They are kept per input, so that runs
    over other inputs keep theirs.
    """

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _spent.pop(sf_dir, []))
        with tracked() as made:
            out = stage(spark, docs, sf_dir)
        _spent[sf_dir] = made
        return out

    return run_stage


STAGES = [
    ("language ID", _swept(language)),
    ("SimHash near-dedup", _swept(near_duplicates)),
    ("PII", _swept(personal_data)),
    ("mixing sources", _swept(mixture)),
    ("best-fit packing", _swept(packed)),
]
#: Compression, tokenising and packing are beyond SQL; tests check run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
