"""Corpus pipeline: quality classifier, exact dedup, near-duplicate join, secret scan and packing.

Each stage takes what the one before it kept, is written as Parquet in the shared folder and read
again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyfold.llm import common
from tallyfold.llm.exact_dedup import drop_exact
from tallyfold.llm.importance import keep_good
from tallyfold.llm.jaccard_join import keep_one
from tallyfold.llm.packing import packed_documents
from tallyfold.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; the others go."""
    return keep_good(docs, common.read(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each component of near duplicates."""
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and offset."""
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
]

#: The classifier's draw and the tokenizer have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.durable(docs, f"pipeline-{k}-{name}")
    return docs
