"""Queries of the training-data operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import best_fit, embedding_pairs, ngram_join, piece_sampling, preferences, quality_classifier, quality_rules, secret_scan, sql, surrogates, token_files
from .common import new_folder

#: The registered query's key; a real job passes a secret one.
SURROGATE_KEY = "lakeloom example key"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, written in shuffled byte planes and digested from the files."""
    path = new_folder(spark, "ids")
    token_files.write(_table(spark, sf_dir, "documents"), path)
    return token_files.read_digests(spark, path)


@_query
def op4_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every text, digested, and whether decoding gives the text back."""
    return piece_sampling.digests(_table(spark, sf_dir, "documents"))


@_query
def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced by keyed surrogates."""
    return surrogates.replace_entities(_table(spark, sf_dir, "documents"), SURROGATE_KEY)


@_query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), 3, 90)


ORACLES["op6_ngram_join"] = sql.OP6


@_query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a scorer trained on weak labels, and whether it is kept."""
    return quality_classifier.classify(_table(spark, sf_dir, "documents"))


@_query
def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with the next conversation's last reply."""
    return preferences.format_with_borrowed_replies(_table(spark, sf_dir, "conversations")).withColumnRenamed("pair", "conv_id")


ORACLES["op8_preferences"] = sql.OP8


@_query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict with its host's."""
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("host", "host_rate")


ORACLES["op9_quality_rules"] = sql.OP9


@_query
def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in bins of 1024, 2048 and 4096 tokens."""
    return best_fit.pack_documents(_table(spark, sf_dir, "documents"))


@_query
def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in every text, the base kinds counted and digested."""
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"))


@_query
def op10_embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings by cosine >= 0.9."""
    return embedding_pairs.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.9)


ORACLES["op10_embedding_pairs"] = sql.OP10
