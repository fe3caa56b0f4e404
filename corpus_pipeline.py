"""From raw documents to packed training sequences: toxicity, exact and near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read again by the
next one.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revcast.llm import exact, minhash, packing, pii, toxicity
from revcast.llm.common import shipped, stored, table
from revcast.llm.queries import tokenizer_path


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance judge does not take for toxic."""
    return toxicity.ordinary_documents(docs, toxicity.trained_judge(docs, table(shipped(spark), sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    shipped(spark)
    return minhash.without_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked by its kind."""
    shipped(spark)
    return pii.masked(docs, pii.trained_tagger(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their places in sequences of 2048."""
    shipped(spark)
    return packing.packed_documents(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [("toxicity", toxic), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("pii", personal_data), ("packing", packed)]

# the stages train models, compare shingles and encode texts, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
