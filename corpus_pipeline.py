"""From raw documents to encoded training data, stage by stage.

Every stage takes the documents its predecessor kept and is written as Parquet before the next one reads
it. All but the last return the columns of ``documents``; the mix repeats a document as often as it is to
be seen, and the last stage encodes what is left.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from auditlens.llm import bpe, exact_dedup, minhash, mixing, quality, queries
from auditlens.session import ship_package, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose learned score is at least 0.5."""
    ship_package(spark)
    return quality.keep_good(docs, queries.quality_ranking(spark, sf_dir))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest id."""
    return exact_dedup.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the one with the smallest id."""
    ship_package(spark)
    return minhash.keep_one_of_each(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    ship_package(spark)
    return mixing.take_mixed(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text, per document taken."""
    ship_package(spark)
    encoded = bpe.token_digests(docs, public_tokenizers.path(queries.TOKENIZER))
    return encoded.withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_filter),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup),
    ("mixing", mix_stage),
    ("bpe", encode_stage),
]

# The first stage learns and the third compares sets: neither has SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
