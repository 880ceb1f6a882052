"""A corpus pipeline over `documents`: language ID, near-dedup, substring dedup, decontamination, mixing.

Each stage works on all that the one before it kept, and all but the last return the columns of documents.
Defined cases are those of the operators: null texts go with the language stage; rows with a null doc_id, and
texts that share an id, are documents of their own; repeated rows are copies, of which one stays; columns beyond
those of `documents` are carried along to the last stage, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common, decontamination, language_id, mixing, near_dedup, substring_dedup

#: A text that even its best language codes in more bits a byte than raw bytes need is like none of them.
MOST_BITS = 8.0


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: `und`, or coded worse than raw bytes."""
    model = language_id.fit(docs.filter(~common.held_out()))
    seen = language_id.identify(spark, docs, model)
    return seen.filter((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MOST_BITS)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class: that with the least id."""
    return near_dedup.keep_one(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that occur elsewhere too; texts that lose nothing stay as they are."""
    cut = substring_dedup.cut_texts(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark items."""
    benchmark = common.table(spark, sf_dir, "benchmark")
    return decontamination.without_leaks(docs, benchmark).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: (doc_id, size, source_size, target, taken)."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", languages),
    ("near_dedup", near_copies),
    ("substring_dedup", repeated_passages),
    ("decontamination", leaks),
    ("mixing", mixture),
]
#: Language models and signatures have no SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialize(docs)
    return docs
