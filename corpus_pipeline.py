"""From documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads:
documents that fail the quality rules go, then those without a determined
language (no letter, or words of none of the learned languages), then all but one document of each near-duplicate group (shingles of
five words, similarity 0.8 or more; op9 has its own contract); the rest is
packed into sequences. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import common, jaccard_join, language_id, packing, quality_rules
from tallymark.llm.bpe import vocabulary_path
from tallymark.session import stage_table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, percent=80, words=5)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("quality_rules", drop_low_quality),
    ("language_id", drop_undetermined),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

# The tagger and the search for fillings have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next reads it."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
