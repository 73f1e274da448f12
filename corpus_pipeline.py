"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Toxic documents go, one document of each group of near-duplicates stays, documents that hold benchmark passages go,
the sources are mixed to their target weights, and the mix is dealt to shards.

Every stage takes null in any column, empty and very long texts, repeated rows and empty tables; further columns of its input are left out. What becomes of
such rows is said by each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontaminate, mixing, neardup, sharding, toxicity
from skein.llm.common import materialise, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model, trained on the labelled ones among them, doesn't reject.

    Null and empty texts have no sentence, score 0 and stay; a null doc_id has no label. Repeated rows are judged alike and all stay or go. A score of exactly one half
    rejects. Without labels, or with those of one kind only, nothing is rejected.
    """
    return toxicity.accepted(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8.

    Of a group the smallest doc_id stays, null last, and of rows with that doc_id the first. Null and empty texts, and texts without words, have no duplicates and all stay.
    """
    return neardup.unique_documents(docs.select(*COLUMNS))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts hold none and stay; items without words match nothing. Repeated rows go or stay together. A passage with just the allowed share of edits is one.
    """
    return decontaminate.clean_documents(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it.

    A null source is one of its own, last. Texts without words are never taken. Among rows of one size, a hash of doc_id, then the place in the input, says which ones are taken once more.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS))


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot, equal texts together where the quotas allow.

    Null and empty texts are dealt like others. Ties go to the lower hash, then to the lower shard; repeated rows each have a slot of their own.
    """
    return sharding.sharded(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", keep_civil),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_clean),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: Training and the LSH stages have no SQL. The operators behind the stages are tested by themselves (near duplicates, edit distances and rates against brute force); the stages for
#: columns, kept rows and awkward cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
