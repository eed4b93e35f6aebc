"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from offerlens.llm import decontamination, minhash, mixing, sharding, toxicity
from offerlens.llm.scratch import Scratch
from offerlens.llm.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, trained on ``labels``, doesn't reject."""
    return toxicity.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies: five-word shingles, similarity 0.8 or more.

    Rows that share an id stay or go together, rows without an id stay.
    """
    found = minhash.near_duplicates(docs, shingle=5, percent=80)
    gone = found.where(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, one row per copy."""
    return mixing.mixed(docs).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy with its shard and its slot there; copies of a document stay together."""
    out = sharding.shard(docs)
    return out.select(*COLUMNS, "size", "text_crc32", "shard", "slot", "grown_shard")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]
ORACLE_SQL = None  # trained scores and seeded draws are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        then = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return then
        docs = scratch.keep(then)
    return docs
