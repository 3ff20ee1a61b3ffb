"""From raw documents to packed training sequences: quality, exact and near duplicates, repeated passages, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import odd_sketch, packing, passage_quality, suffix_dedup, trie_dedup
from folio.llm.catalog import tokenizer_path
from folio.llm.cluster import ready
from folio.session import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return passage_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return trie_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8."""
    return odd_sketch.deduplicate(docs, shingle=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that another document, or they themselves, have before."""
    return suffix_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.packed_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("suffix_dedup", passages), ("packing", pack)]

#: Trained and evolved stages are beyond SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
