"""A training corpus from documents: rejected by rule, deduplicated, mixed, packed.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
All but the last return the columns of documents; the last returns one row per
packed piece. Null and empty texts fail the quality rules and go with the first
stage; the other cases are those of the stages' operators. Empty documents give an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelflight.llm import exact_dedup, mixing, packing, quality, simhash
from shelflight.storage import fresh_path, remove, settled_tables


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the distribution rules reject go."""
    return quality.drop_rejected(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the smallest doc_id stays."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixture's documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", drop_exact_copies),
    ("simhash near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("best-fit packing", pack),
]

# Models, fingerprints and token ids have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage settles goes when its result is written, and
    a stage's result when the next one is; only the last result stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for at, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage-{at}")
        with settled_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
