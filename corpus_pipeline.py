"""From raw documents to a mix: quality, near duplicates, benchmark passages, personal data, source weights.

Each stage works on all that its predecessor kept, which is written as Parquet into the shared folder
and read again: a lost executor costs the tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.llm import decontaminate, learn, near_dups, pseudonyms, quality, source_mix
from auralake.llm.common import table
from auralake.scratch import scope, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by the labels of the folds it may learn from, takes for good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), ~learn.held_out("doc_id", 4, 2))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each class of near duplicates."""
    return near_dups.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is 0.8 similar or more to a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; n_chars counts the new text."""
    return pseudonyms.pseudonymise(docs, pseudonyms.configured_key(spark), found=None).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the documents with words in it, and how many."""
    return source_mix.mix_sources(docs).where("taken > 0").drop("key")


STAGES = [
    ("quality classifier", good),
    ("MinHash near-dedup", distinct),
    ("benchmark decontamination", clean),
    ("PII", private),
    ("mixing sources to target weights", mixed),
]

#: The classifier has no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gives. What a stage has written on its way is removed when its result is there; the
    results themselves stay in the shared folder until auralake.scratch.release."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scope(spark):
            docs = written(stage(spark, docs, sf_dir), lasting=True)
    return docs
