"""The corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its
result is written as Parquet and read again as the next one's documents. All stages but the
last return the columns of ``documents`` (and any further ones of the input).

Defined results: rows with a null doc_id, or one that repeats, are documents like any other;
near-duplicates are told by id and text, so distinct texts never stand for each other, and rows
that repeat both are one; a null text has no words and goes with the first stage; an empty table
gives an empty result; columns whose names the operators use themselves pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.llm import packing, quality_rules, simhash, substring_dedup, toxicity
from skerry.llm.common import drop_materialized, materialize, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their failing lines."""
    return quality_rules.filter_documents(docs)


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the classifier learns from the labels of documents still there."""
    return toxicity.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id; a document is its id and text."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier document has; emptied documents go."""
    return substring_dedup.apply(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, with their sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("toxicity", clean_speech),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", packed),
]

#: SQL can't express the stages with a classifier, fingerprints and packing; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir)))
        if before is not None:
            drop_materialized(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
