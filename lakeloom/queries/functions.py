"""Scalar functions of the dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compat
from ..plans.dialect import query as dialect_query
from ..sources.tables import table
from .registry import query


@query("SELECT c_custkey, c_name || '-' || c_mktsegment AS a, c_name || nullif(c_mktsegment, 'BUILDING') AS b FROM customer")
def fn_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", compat.concat(F.col("c_name"), F.lit("-"), F.col("c_mktsegment")).alias("a"), compat.concat(F.col("c_name"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))).alias("b"))


@query("SELECT c_custkey, substr(c_name, 3) AS a, substr(c_name, 2, 4) AS b, substr(c_name, 1, 1) AS z FROM customer")
def fn_substr(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", compat.substr(name, 3).alias("a"), compat.substr(name, 2, 4).alias("b"), compat.substr(name, 0, 2).alias("z"))


@query("SELECT c_custkey, length(c_name) AS n, lower(c_name) AS low, upper(c_mktsegment) AS up, trim('  ' || c_name || ' ') AS bare FROM customer")
def fn_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect_query(spark, "SELECT c_custkey, LENGTH(c_name) AS n, LOWER(c_name) AS low, UPPER(c_mktsegment) AS up, TRIM('  ' || c_name || ' ') AS bare FROM customer", customer=table(spark, sf_dir, "customer"))


@query("SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS k, nullif(c_mktsegment, 'BUILDING') AS m FROM customer")
def fn_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect_query(spark, "SELECT c_custkey, COALESCE(NULLIF(c_nationkey, 3), -1) AS k, NULLIF(c_mktsegment, 'BUILDING') AS m FROM customer", customer=table(spark, sf_dir, "customer"))


@query("SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS mo, CAST(day(ts) AS INT) AS d, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS mi, CAST(second(ts) AS INT) AS s, CAST(dayofweek(ts) AS INT) AS dow, CAST(dayofyear(ts) AS INT) AS doy, CAST(floor(epoch(ts)) AS BIGINT) AS ep FROM events")
def fn_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"y": "year", "mo": "month", "d": "day", "h": "hour", "mi": "minute", "s": "second", "dow": "dow", "doy": "doy", "ep": "epoch"}
    return table(spark, sf_dir, "events").select("event_id", *(compat.extract(f, F.col("ts")).alias(n) for n, f in fields.items()))


@query("SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS h, strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M:%S') AS m FROM events")
def fn_date_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect_query(spark, "SELECT event_id, DATE_TRUNC('hour', ts) AS h, DATE_TRUNC('month', ts) AS m FROM events", events=table(spark, sf_dir, "events"))
