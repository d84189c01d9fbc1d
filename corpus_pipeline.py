"""The corpus pipeline: quality rules, quality classifier, n-gram Jaccard join, secret scans, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import best_fit, ngram_join, quality_classifier, quality_rules, secret_scan
from lakeloom.llm.common import stored


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their own measures and their host's verdict keep."""
    return quality_rules.reject(docs)


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer trained on these documents' weak labels keeps."""
    return quality_classifier.reject(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    return ngram_join.keep_one(docs, 5, 80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by marks and n_chars following."""
    return secret_scan.redact(docs, n_chars="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in training sequences."""
    return best_fit.pack_documents(docs)


STAGES = [
    ("quality_rules", by_rules),
    ("quality_classifier", by_classifier),
    ("ngram_jaccard_join", one_of_each),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]

#: A trained scorer and sampled bin ranks aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
