"""The corpus pipeline: stages that each apply one operator of evistra.llm to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evistra.llm import bpe, mixing, pii, quality_classifier, simhash
from evistra.llm._common import materialize, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with their columns.

    Null and empty texts are judged as texts without words; repeated rows stay or go together; without labels all stay.
    """
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id, with its columns.

    Null and empty texts are one group; of a repeated doc_id one row stays; rows without a doc_id all stay.
    """
    return simhash.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind and n_chars counted anew; null texts stay null."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in shuffled shards: not at all, once or more; one may be cut at a quota.

    Null and empty texts have no words and are not taken; a null source is a source of its own.
    """
    return mixing.mix(docs).select("row.*")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the tokens of every mixed document, a row for each time it was taken."""
    return bpe.bpe_report(docs)


STAGES = [
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", near_dedup),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: The stages can't be expressed in SQL (trained models, a tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
