"""Statements that change tables, change events and live queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dml
from ..operators.aggregates import rate_per_minute as with_rate
from ..plans.statements import change
from ..sources.tables import table
from ..streaming import cdc, hlc, live
from .registry import query

_NEW = "SELECT c_custkey + 1000000 * (c_custkey % 2) AS c_custkey, 'new' AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 = 0"


def _new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The customers, and incoming rows: half of them known keys."""
    c = table(spark, sf_dir, "customer")
    return c, c.where("c_custkey % 5 = 0").withColumn("c_custkey", F.expr("c_custkey + 1000000 * (c_custkey % 2)")).withColumn("c_name", F.lit("new"))


@query(f"SELECT * FROM customer UNION ALL SELECT * FROM ({_NEW}) WHERE c_custkey > 1000000")
def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, new = _new(spark, sf_dir)
    return dml.insert(c, new.where("c_custkey > 1000000"))


@query(f"SELECT * FROM customer UNION ALL SELECT * FROM ({_NEW}) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def dml_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.insert_ignore(*_new(spark, sf_dir), ["c_custkey"])


@query(f"SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ({_NEW})) UNION ALL SELECT * FROM ({_NEW})")
def dml_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.upsert(*_new(spark, sf_dir), ["c_custkey"])


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN nullif(c_nationkey, 3) > 10 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.update(table(spark, sf_dir, "customer"), {"C_ACCTBAL": F.lit(0.0)}, F.expr("nullif(c_nationkey, 3) > 10"), ["c_custkey"])


@query("SELECT * FROM customer WHERE NOT coalesce(nullif(c_nationkey, 3) > 10, false)")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.delete(table(spark, sf_dir, "customer"), F.expr("nullif(c_nationkey, 3) > 10"))


@query(f"SELECT c_custkey, c_name FROM ({_NEW})")
def dml_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.returning(_new(spark, sf_dir)[1], "c_custkey", "c_name")


# The same as statements.
def _changed(spark: SparkSession, sf_dir: str, sql: str, params: list | None = None):
    return change(spark, sql, params, {"customer": ["c_custkey"]}, customer=table(spark, sf_dir, "customer"))


@query(f"SELECT * FROM customer UNION ALL SELECT * FROM ({_NEW}) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def sql_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir, f"INSERT INTO customer {_NEW} ON CONFLICT (c_custkey) DO NOTHING").rows


@query(f"SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ({_NEW})) UNION ALL SELECT * FROM ({_NEW})")
def sql_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir, f"INSERT OR REPLACE INTO customer (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) {_NEW}").rows


@query("SELECT c_custkey, c_name || ' (WHERE)' AS c_name, c_nationkey, c_acctbal - 5 AS c_acctbal, c_mktsegment FROM customer WHERE c_nationkey > 10 UNION ALL SELECT * FROM customer WHERE NOT coalesce(c_nationkey > 10, false)")
def sql_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir, "UPDATE customer SET c_name = c_name || ' (WHERE)', C_ACCTBAL = c_acctbal - ? WHERE c_nationkey > ?;", [5, 10]).rows


@query("SELECT * FROM customer WHERE NOT coalesce(c_nationkey BETWEEN 3 AND 9 AND c_mktsegment <> 'BUILDING', false)")
def sql_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir, "DELETE FROM customer WHERE c_nationkey BETWEEN $1 AND $2 AND c_mktsegment <> $3", [3, 9, "BUILDING"]).rows


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0")
def sql_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir, "DELETE FROM customer WHERE c_acctbal < 0 RETURNING c_custkey, c_name").touched


@query("SELECT *, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM (SELECT c_custkey, c_name AS title, c_acctbal, c_mktsegment FROM customer) JOIN (SELECT c_custkey, c_nationkey FROM customer) USING (c_custkey)".replace("*, ", "c_custkey, title, c_acctbal, c_mktsegment, "))
def sql_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = _changed(spark, sf_dir, 'ALTER TABLE customer RENAME COLUMN c_name TO "title"').rows
    return change(spark, "ALTER TABLE t ALTER COLUMN c_nationkey TYPE VARCHAR(9)", t=renamed).rows


@query("SELECT *, CAST(7 AS BIGINT) AS extra FROM region")
def ddl_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.add_column(table(spark, sf_dir, "region"), "extra", "bigint", 7)


@query("SELECT n_nationkey, n_name AS title, n_regionkey FROM nation")
def ddl_rename_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.rename_column(table(spark, sf_dir, "nation"), "n_name", "title")


@query("SELECT n_nationkey, n_name FROM nation")
def ddl_drop_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.drop_column(table(spark, sf_dir, "nation"), "n_regionkey", ["n_nationkey"])


@query("SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def ddl_alter_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.alter_type(table(spark, sf_dir, "nation"), "n_regionkey", "string")


# Change events: events as a log of changes to users
_OP = "CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'signup' THEN 'INSERT' ELSE 'UPDATE' END"
_LOG = f"(SELECT user_id, {_OP} AS operation, event_type, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS value, epoch_us(ts) AS physical, event_id FROM events)"
_NEWEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY physical DESC, event_id DESC) AS r FROM {_LOG}) WHERE r = 1"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "signup", "INSERT").otherwise("UPDATE")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    value = F.when(F.col("event_type") != "click", F.col("value"))
    return e.select("user_id", op.alias("operation"), "event_type", value.alias("value"), hlc.stamp(micros, F.col("event_id"), F.lit("n1")).alias("hlc"), "event_id")


@query("SELECT * FROM (VALUES ('INSERT INTO t VALUES (1)', 'INSERT'), ('insert or replace into t values (1)', 'INSERT'), ('UPDATE t SET a = 1', 'UPDATE'), (' delete from t', 'DELETE'), ('SELECT 1', NULL)) AS v(statement, operation)")
def cdc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements = ["INSERT INTO t VALUES (1)", "insert or replace into t values (1)", "UPDATE t SET a = 1", " delete from t", "SELECT 1"]
    return spark.createDataFrame([(s,) for s in statements], "statement string").withColumn("operation", cdc.operation_column(F.col("statement")))


@query(f"SELECT user_id, operation, event_type, value, event_id FROM ({_NEWEST}) WHERE operation <> 'DELETE'")
def cdc_lww_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.apply_changes(_log(spark, sf_dir), ["user_id"], "hlc").drop("hlc")


@query(f"SELECT user_id, arg_max(value, (physical, event_id)) FILTER (value IS NOT NULL) AS value, arg_max(event_type, (physical, event_id)) AS event_type FROM {_LOG} GROUP BY user_id")
def cdc_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.backfill(_log(spark, sf_dir), ["user_id"], "hlc", ["value", "event_type"])


@query(f"SELECT DISTINCT user_id, operation FROM {_LOG}")
def cdc_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).select("user_id", "operation")
    return cdc.dedupe(log.unionByName(log), ["user_id", "operation"])


@query(f"SELECT 'users' AS tbl, user_id, event_id FROM ({_NEWEST}) ORDER BY physical DESC, event_id DESC LIMIT 40")
def cdc_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each row, as many as a buffer of 40 holds."""
    log = _log(spark, sf_dir).select(F.lit("users").alias("tbl"), "user_id", "event_id", "hlc")
    return cdc.coalesce_latest(log, "tbl", "user_id", "hlc", 40).drop("hlc")


_HALF = "epoch_us(TIMESTAMP '2024-01-15 00:00:00')"


@query(f"SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY physical DESC, event_id DESC) AS r FROM {_LOG} WHERE physical < {_HALF}) WHERE r = 1 AND operation <> 'DELETE'")
def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct(F.unix_micros(F.lit("2024-01-14 23:59:59.999999").cast("timestamp")).alias("physical"), F.lit(2**31 - 1).alias("logical"), F.lit("~").alias("node"))
    return cdc.as_of(_log(spark, sf_dir), ["user_id"], "hlc", at).select("user_id", "event_type", "event_id")


@query(f"SELECT event_type, arg_min(event_id, (physical, event_id)) AS first, arg_max(event_id, (physical, event_id)) AS last FROM {_LOG} GROUP BY event_type")
def hlc_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last event of each type by their stamps."""
    return _log(spark, sf_dir).groupBy("event_type").agg(F.min_by("event_id", "hlc").alias("first"), F.max_by("event_id", "hlc").alias("last"))


@query(f"SELECT event_id, event_type, row_number() OVER (ORDER BY physical, event_id) AS place FROM {_LOG}")
def hlc_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event in the order of all stamps, with its place. Places come from counts per hour, so no task ranks all rows."""
    log = _log(spark, sf_dir).select("event_id", "event_type", "hlc").withColumn("hour", F.expr("hlc.physical div 3600000000"))
    starts = log.groupBy("hour").agg(F.count("*").alias("n")).selectExpr("hour AS h", "sum(n) OVER (ORDER BY hour) - n AS base")
    placed = log.selectExpr("*", "row_number() OVER (PARTITION BY hour ORDER BY hlc) AS k").join(starts, F.col("hour").eqNullSafe(F.col("h")))
    return placed.orderBy("hlc").select("event_id", "event_type", F.expr("base + k").alias("place"))


_LIVE = "LIVE SELECT event_id, event_type, value FROM events WHERE event_type LIKE 'PURCH%' AND value > 20"


@query("SELECT event_id, event_type, value FROM events WHERE event_type ILIKE 'PURCH%' AND value > 20")
def live_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(live.LiveQuery(_LIVE).predicate).select("event_id", "event_type", "value")


@query("SELECT event_id, event_type, value, 'snapshot' AS event FROM events WHERE event_type ILIKE 'PURCH%' AND value > 20")
def live_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.LiveQuery(_LIVE).snapshot(table(spark, sf_dir, "events"))


@query(
    f"""WITH m AS (SELECT *, operation <> 'DELETE' AND coalesce(event_type IN ('purchase', 'view') AND value > 20, false) AS hit FROM {_LOG}),
    l AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY user_id ORDER BY physical, event_id), false) AS was FROM m)
    SELECT event_id, user_id, CASE WHEN hit AND was THEN 'update' WHEN hit THEN 'insert' ELSE 'delete' END AS event FROM l WHERE hit OR was"""
)
def live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of each user's row into, within and out of the predicate."""
    hit = F.col("event_type").isin("purchase", "view") & (F.col("value") > 20)
    return live.transitions(_log(spark, sf_dir), "user_id", ["hlc"], hit).select("event_id", "user_id", "event")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_rate_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.event_rate(table(spark, sf_dir, "events"), "ts", "1 day", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    """WITH c AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    l AS (SELECT *, n - lag(n) OVER w AS dn, ms - lag(ms) OVER w AS dt FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id))
    SELECT event_id, round(CASE WHEN dn > 0 AND dt > 0 THEN dn * 60000.0 / dt ELSE 0.0 END, 6) AS per_minute FROM l""",
    name="rate_per_minute",
)
def _rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    counted = e.selectExpr("user_id", "event_id", "unix_millis(CAST(ts AS TIMESTAMP)) AS ms", "count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n")
    rated = with_rate(counted, "n", "ms", "user_id")
    return rated.select("event_id", F.round("per_minute", 6).alias("per_minute"))
