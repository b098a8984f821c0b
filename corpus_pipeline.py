"""Corpus pipeline: five stages over the table documents, each written as Parquet and read again by the next.

Every stage but the last returns the columns of its input, whatever they are called. A document that a stage rejects is gone
for all later ones. An empty table passes through all stages as an empty table. Rows are kept or dropped as they are: a null
text counts as an empty one, a null id is an id like any other for every stage that doesn't say otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, ngram_join, packing, quality, toxicity
from tidemark.llm.common import stage, table

#: Words that packing keeps here, in bytes: executors hold what earlier stages grew to.
KEPT_BYTES = 48 << 20


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; labels are those of the corpus outside the held-out fold.

    Null and empty texts have no evidence and score the offset alone; equal texts share a score, so repeated rows and ties
    are kept or dropped together. Ids serve to find labels only; a null id has none.
    """
    return toxicity.not_toxic(docs, table(spark, sf_dir, "labels"))


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer finds good, at 0.5 or more.

    Null and empty texts get a score from their lack of statistics; equal texts share a score. Ids only take part in the
    hash that draws the bounded training sample.
    """
    return quality.good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (white space aside): the longest, then the smallest id, a null id last.

    Null, empty and blank texts are equal, so one of them stays; of rows that tie in length and id, one stays.
    """
    return exact_dedup.distinct_texts(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links: five-word shingles, similarity 0.8 or more; the smallest id.

    Texts without words are linked with nothing and stay. Rows that share an id go or stay together; a null id stays only
    where its component has no other.
    """
    return ngram_join.one_of_each(docs, n=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids; a null or empty text is the end id alone, rows that repeat an id are packed apart."""
    return packing.pack(docs, kept=KEPT_BYTES)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_low_quality),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("packing", pack),
]
#: The classifiers can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
