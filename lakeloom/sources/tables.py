"""Table sources: the parquet tables of a directory, their keys, and delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Primary keys of the tables that have one.
PRIMARY_KEYS: dict[str, list[str]] = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"],
    "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"],
    "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; Catalyst prunes its columns and pushes filters to the files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temp views over the named tables, for SQL text."""
    for name in names or PRIMARY_KEYS:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Tab-separated rows without a header, under an explicit schema; a malformed row fails the read."""
    return spark.read.csv(path, sep="\t", schema=schema, mode="FAILFAST")
