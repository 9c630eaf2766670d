"""Corpus pipeline: quality filter, near-duplicate removal, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept, read back from Parquet. All but the
last return the columns of documents; the last returns the packed pieces. Texts keep their place in the corpus by doc_id
throughout. Nulls, empty and repeated texts, repeated ids, empty tables and further columns of any name are defined in the
operators' docstrings: a stage gives back all columns as they are but for what it decides or redacts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import secrets
from webloom.llm.packing import pack_documents
from webloom.llm.quality import fit_quality, in_learning_part, keep_accepted
from webloom.llm.simhash import keep_one_of_each
from webloom.session import materialise, ship_package, table

LEAST_SCORE = 0.3
TOKENIZER = "word_bpe_49k.json"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it learns from the labelled rows that are not held out."""
    ship_package(spark)
    model = fit_quality(docs, table(spark, sf_dir, "labels"), learn=in_learning_part(F.col("doc_id")))
    return keep_accepted(docs, model, LEAST_SCORE)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingle sets of similarity 0.8 or more; the smallest doc_id stays."""
    ship_package(spark)
    return keep_one_of_each(docs, words=5, similarity=0.8)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by a mark and n_chars counted anew where the text changed."""
    weights = secrets.train(secrets.default_samples(spark))
    return secrets.redact_secrets(docs, weights)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 4096 tokens."""
    ship_package(spark)
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), end_id=1, capacity=4096)


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_duplicate_removal),
    ("secret scans", secret_redaction),
    ("best-fit packing", best_fit_packing),
]

#: Compression, fingerprints and the vocabulary have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
