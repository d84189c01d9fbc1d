"""The programmatic runtime as queries: movement, exchange, batches, operations, diagnostics."""

from __future__ import annotations

import json
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import movement
from ..operators.aggregates import numeric_aware
from ..plans.classifier import classify
from ..plans.dialect import query as dialect_query
from ..plans.logs import LogSearch, since
from ..runtime.budgets import prefix_within
from ..runtime.operation import partials, reduced, staged
from ..session import BROADCAST_LIMIT_BYTES
from ..sources.tables import table
from .registry import query

_SIDES = "(VALUES (1, 1000, NULL, NULL), (2, 999999, 'pk', NULL), (3, 999999, 'scan', NULL), (4, 999999, NULL, 'broadcast'), (5, 1000, NULL, 'broadcast'), (6, 999999, 'scan', 'lookup'), (7, 10, 'unique', 'lookup'), (8, 10, NULL, 'emit_shuffle'), (9, 10, NULL, 'guess')) AS v(id, size, path, hint)"


@query(
    f"""SELECT id, CASE WHEN hint IS NULL THEN CASE WHEN size <= {BROADCAST_LIMIT_BYTES} THEN 'broadcast' WHEN path IN ('pk', 'unique', 'bounded') THEN 'lookup' ELSE 'emit_shuffle' END
    WHEN hint = 'broadcast' AND size <= {BROADCAST_LIMIT_BYTES} OR hint = 'lookup' AND path IN ('pk', 'unique', 'bounded') OR hint = 'emit_shuffle' THEN hint ELSE 'rejected' END AS strategy FROM {_SIDES}"""
)
def strategy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = spark.sql(f"SELECT * FROM {_SIDES}")
    return sides.select("id", movement.strategy_column(F.col("size"), F.col("path"), F.col("hint")).alias("strategy"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 3, 32, 96)")
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([(k,) for k in (1, 2, 3, 32, 96, 96, 1)], "o_orderkey long")
    return movement.lookup_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), keys, "o_orderkey")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def broadcast_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision's strategy: nation's estimated size is within the limit, so it is broadcast."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined, _ = movement.join_by_decision(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nation, ["c_nationkey"])
    return joined.select("c_custkey", "n_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 50 ORDER BY o_orderkey")
def call_iterator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect_query(spark, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < ? ORDER BY o_orderkey", [50], orders=table(spark, sf_dir, "orders"))


@query("SELECT batch, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch FROM orders) GROUP BY batch")
def stage_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handler runs beside the data for each batch of 1000 orders by key."""

    def handler(batch: int, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"batch": [batch], "n": [len(rows)], "first": [rows["o_orderkey"].iloc[0]]})

    return staged(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", handler, "batch long, n long, first long")


@query("SELECT event_type, chunk, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS bytes, chunk = max(chunk) OVER (PARTITION BY event_type) AS done FROM (SELECT event_type, props, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 10000 AS chunk FROM events) GROUP BY event_type, chunk")
def reduce_handler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's handler for each key, in chunks of 10 000 records."""

    def handler(key: str, records: pd.DataFrame, chunk: int, token: str | None) -> pd.DataFrame:
        size = records["props"].str.len().fillna(0).sum()
        return pd.DataFrame({"event_type": [key], "chunk": [chunk], "n": [len(records)], "bytes": [int(size)], "done": [token is None]})

    events = table(spark, sf_dir, "events").select("event_type", "event_id", "props")
    return reduced(events, "event_type", ["event_id"], handler, "event_type string, chunk long, n long, bytes long, done boolean")


@query("SELECT v, row_number() OVER (ORDER BY TRY_CAST(v AS DOUBLE) IS NULL, TRY_CAST(v AS DOUBLE), v) AS place FROM (SELECT CAST(p_size AS VARCHAR) AS v FROM part UNION SELECT p_brand FROM part)")
def sort_numeric_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sizes and brands as text: numbers by value, then the rest."""
    part = table(spark, sf_dir, "part")
    values = part.select(F.col("p_size").cast("string").alias("v")).union(part.select("p_brand")).distinct()
    return values.withColumn("place", F.row_number().over(Window.orderBy(*numeric_aware("v"))).cast("long"))


@query("SELECT n_name, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(n_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 16 AS INT) AS bucket FROM nation")
def exchange_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_name", movement.bucket_of(F.col("n_name")).alias("bucket"))


@query("SELECT event_type AS key, count(*) AS records, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY event_type")
def emit_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables have no total cap: that is the budget of one run's buffer."""
    emitted = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value"))
    return movement.emitted_within(emitted, "key", "value", None).groupBy("key").agg(F.count("*").alias("records"), F.sum(F.octet_length("value").cast("long")).alias("bytes"))


@query("SELECT l_returnflag AS key, count(*) AS records, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY l_returnflag")
def reduce_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    return movement.reduce_by_key(rows, "key", F.count("*").alias("records"), F.sum("v").cast("double").alias("total"))


@query(
    """WITH r AS (SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100 AS chunk, (count(*) OVER (PARTITION BY event_type) - 1) // 100 AS last FROM events)
    SELECT event_type, CAST(chunk AS INT) AS chunk, count(*) AS n, CASE WHEN chunk < last THEN event_type || '-chunk-' || chunk END AS token FROM r GROUP BY event_type, chunk, last"""
)
def reduce_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = movement.with_continuation(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", ["event_id"], 100)
    return rows.groupBy("event_type", "chunk", "token").agg(F.count("*").alias("n")).select("event_type", "chunk", "n", "token")


@query("SELECT CAST(user_id AS VARCHAR) AS lineage_id, event_type AS stage_id, arg_min(value, event_id) AS value, min(event_id) AS event_id FROM events GROUP BY ALL")
def dedupe_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("lineage_id"), F.col("event_type").alias("stage_id"), "value", "event_id")
    return movement.dedupe_lineage(rows, ["event_id"])


@query("SELECT ts, event_id, event_type, props FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' AND event_type = 'click' AND props LIKE '%1%' ORDER BY ts DESC, event_id DESC LIMIT 200")
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = datetime(2024, 1, 20)
    search = LogSearch("events", (("event_type", "click"), ("user_id", None)), since("-15d", at), at, "1", "props", ("ts", "event_id"), "ts, event_id, event_type, props")
    return dialect_query(spark, *search.statement(), events=table(spark, sf_dir, "events"))


@query("SELECT user_id % 10 AS service, length(event_type) % 3 AS part, count(*) FILTER (event_type <> 'purchase') AS read, count(*) FILTER (event_type = 'purchase') AS write FROM events GROUP BY ALL")
def access_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "write").otherwise("read")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("service"), (F.length("event_type") % 3).alias("part"), kind.alias("kind"))
    return rows.groupBy("service", "part").pivot("kind", ["read", "write"]).count().na.fill(0, ["read", "write"])


def _summarise(rows: list[dict], args: object, emit) -> None:
    """Count and cents of each account's orders, added up within the batch."""
    totals: dict[int, list[int]] = {}
    for r in rows:
        t = totals.setdefault(r["o_custkey"] % 50, [0, 0])
        t[0] += 1
        t[1] += round(r["o_totalprice"] * 100)
    for account, (n, cents) in totals.items():
        emit(f"{account}:count", n)
        emit(f"{account}:cents", cents)


@query("SELECT o_custkey % 50 AS account, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY o_custkey % 50")
def call_binding_account_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run beside the data, partials combined by key and reduced to a row per account."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    found = partials(orders, ["o_orderkey"], None, _summarise, max_emits=100)
    split = found.select(F.split("key", ":")[0].cast("long").alias("account"), F.split("key", ":")[1].alias("what"), "whole")
    return split.groupBy("account").agg(F.sum(F.when(F.col("what") == "count", F.col("whole"))).cast("long").alias("n"), F.sum(F.when(F.col("what") == "cents", F.col("whole"))).cast("long").alias("cents"))


@query("SELECT count(*) AS accounts, CAST(0 AS BIGINT) AS shared FROM (SELECT DISTINCT o_custkey FROM orders)")
def call_binding_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by account emit disjoint keys: none is emitted by two."""

    def run(rows: list[dict], args: object, emit) -> None:
        for key in {r["o_custkey"] for r in rows}:
            emit(str(key), 1)

    found = partials(table(spark, sf_dir, "orders").select("o_custkey"), ["o_custkey"], None, run, max_rows=4096, max_emits=4096)
    return found.groupBy("key").agg(F.count_distinct("shard").alias("shards")).agg(F.count("*").alias("accounts"), F.count_if(F.col("shards") > 1).alias("shared"))


#: Statements made for each rule: point lookups, lists up to 100 markers, limited ranges, and what is never bounded.
_CALLS = [
    ("SELECT title, pages FROM books WHERE isbn = ?", "BOUNDED"),
    (f"SELECT title FROM books WHERE isbn IN ({', '.join('?' * 100)})", "BOUNDED"),
    (f"SELECT title FROM books WHERE isbn IN ({', '.join('?' * 101)})", "UNBOUNDED"),
    ("SELECT due FROM loans WHERE reader = ANY(?)", "BOUNDED"),
    ("SELECT reader FROM loans WHERE due BETWEEN ? AND ? ORDER BY due LIMIT 25", "BOUNDED"),
    ("SELECT reader FROM loans WHERE due BETWEEN ? AND ?", "UNBOUNDED"),
    ("SELECT count(*) AS n FROM shelves WHERE height >= ?", "UNBOUNDED"),
    ("SELECT floor FROM shelves ORDER BY floor", "UNBOUNDED"),
    ("SELECT title FROM books WHERE EXISTS (SELECT 1 FROM loans WHERE loans.isbn = books.isbn)", "UNBOUNDED"),
    ("SELECT b.title FROM loans l LEFT JOIN books b ON b.isbn = l.isbn WHERE l.reader = ?", "UNBOUNDED"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{v}')" for s, v in _CALLS) + ") AS v(statement, classification)")
def nested_call_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def judge(statements: pd.Series) -> pd.Series:
        return statements.map(lambda s: classify(s).classification)

    return spark.createDataFrame([(s,) for s, _ in _CALLS], "statement string").withColumn("classification", judge("statement"))


_PAYLOAD = "length(props)"


@query(f"SELECT event_id, CAST(total AS BIGINT) AS total_bytes FROM (SELECT event_id, sum({_PAYLOAD}) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT * FROM events ORDER BY event_id LIMIT 500)) WHERE total <= 3000")
def result_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix of events that fits 500 rows and 3000 bytes of props."""
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return prefix_within(events, ["event_id"], F.octet_length("props").cast("long"), 500, 3000).select("event_id", "total_bytes")


@query("WITH l AS (SELECT user_id, max(value) AS latency FROM events GROUP BY user_id), m AS (SELECT median(latency) AS med FROM l) SELECT user_id, round(latency - 1.2 * med, 4) AS excess FROM l, m WHERE latency > 1.2 * med")
def straggler_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those slower than a multiple of the median, with their excess."""
    latency = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("latency"))
    median = latency.agg(F.percentile("latency", 0.5).alias("med"))
    return latency.crossJoin(F.broadcast(median)).where("latency > 1.2 * med").selectExpr("user_id", "round(latency - CAST(1.2 AS DOUBLE) * med, 4) AS excess")


@query("SELECT * FROM nation")
def strip_partition_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal fields of a scan don't reach the user."""
    inner = table(spark, sf_dir, "nation").withColumns({"__partition": F.spark_partition_id(), "__replica": F.lit("r1")})
    return inner.drop(*(c for c in inner.columns if c.startswith("__")))


@query("SELECT count(*) AS n, CAST(sum(100 * o_custkey + ordinal) AS BIGINT) AS total FROM orders JOIN (SELECT c_custkey, ordinal FROM customer, range(8) t(ordinal)) ON o_custkey = c_custkey")
def bench_request_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order joined to eight rows of its customer."""
    requests = table(spark, sf_dir, "orders").select("o_custkey")
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "explode(sequence(0, 7)) AS ordinal")
    joined = requests.join(rows, F.col("o_custkey") == F.col("c_custkey"))
    return joined.agg(F.count("*").alias("n"), F.sum(100 * F.col("o_custkey") + F.col("ordinal")).alias("total"))


@query("SELECT count(*) AS n, CAST(sum(10 * p_partkey + CASE WHEN p_size < 25 THEN 100000 ELSE 0 END) AS BIGINT) AS total, count(DISTINCT p_partkey) AS rows_ FROM lineitem JOIN part ON l_partkey = p_partkey")
def bench_change_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About half the parts updated, then one lookup for each line."""
    from ..operators.dml import update

    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size", "10 * p_partkey AS value")
    rows = update(parts, {"value": F.col("value") + 100000}, F.col("p_size") < 25, ["p_partkey"])
    found = table(spark, sf_dir, "lineitem").select("l_partkey").join(rows, F.col("l_partkey") == F.col("p_partkey"))
    return found.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count_distinct("p_partkey").alias("rows_"))


def decision_record(spark: SparkSession, *decisions: movement.Decision) -> str:
    """Decisions as JSON, for logs."""
    return json.dumps([d._asdict() for d in decisions])
