"""Projections, filters, joins, aggregates, ordering and set operations.

One statement serves Spark and DuckDB where both read it alike; {name} marks a
table. Where the dialects part, the DuckDB text stands beside it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compat import any_field_contains
from ..operators.aggregates import mode, select_star_with, sum_or_null
from ..plans.dialect import query as dialect_query
from ..plans.pruning import partitions_reached, classify_predicate, route, split_side
from ..session import BROADCAST_LIMIT_BYTES
from ..sources.catalog import KeyedReads
from ..sources.tables import table
from .registry import query

_TABLE = re.compile(r"\{(\w+)\}")


def same(name: str, sql: str, duck: str | None = None) -> None:
    """Register a statement that both engines run."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dialect_query(spark, _TABLE.sub(r"\1", sql), **{t: table(spark, sf_dir, t) for t in set(_TABLE.findall(sql))})

    build.__name__ = name
    query(_TABLE.sub(r"\1", duck or sql))(build)


# Scans, projections, expressions
same("scan_all", "SELECT * FROM {nation}")
same("project_cols", "SELECT n_nationkey AS id, n_name AS name FROM {nation}")
same("table_alias", "SELECT n.n_name, r.r_name FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey")
same("select_no_from", "SELECT 1 + 1 AS two, 'a' AS letter, CAST(NULL AS INT) AS nothing")
same("select_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey % 5 AS part FROM {customer}")
same("with_text", "WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 10), named AS (SELECT c_custkey, c_name FROM {customer}) SELECT c_name, n FROM big JOIN named ON o_custkey = c_custkey")
same("agg_default_name", "SELECT COUNT(*), MIN(l_linenumber), MAX(l_linenumber) FROM {lineitem}", "SELECT count(*) AS \"COUNT(*)\", min(l_linenumber) AS \"MIN(l_linenumber)\", max(l_linenumber) AS \"MAX(l_linenumber)\" FROM lineitem")
same("int_slash", "SELECT o_orderkey, o_custkey / 7 AS q, -o_custkey / 7 AS neg, o_custkey / (o_custkey % 2) AS maybe, o_totalprice / 2 AS half FROM {orders}", "SELECT o_orderkey, CAST(o_custkey // 7 AS DOUBLE) AS q, CAST(-o_custkey // 7 AS DOUBLE) AS neg, CAST(o_custkey // nullif(o_custkey % 2, 0) AS DOUBLE) AS maybe, o_totalprice / 2 AS half FROM orders")
same("quoted_text", """SELECT c_custkey, 'say "hi"' AS a, 'it''s' AS b, c_name AS "the name" FROM {customer} WHERE c_mktsegment <> '"BUILDING"'""")


@query("SELECT * FROM nation WHERE n_nationkey = 7")
def cache_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return spark.createDataFrame([r] if (r := KeyedReads(nation, "n_nationkey").get(7)) else [], nation.schema)


@query("SELECT count(*) AS n FROM nation WHERE n_regionkey = 2")
def cache_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = KeyedReads(table(spark, sf_dir, "nation"), "n_nationkey")
    return spark.createDataFrame([(KeyedReads(reads.filter(F.col("n_regionkey") == 2), "n_nationkey").count(),)], "n long")


same("case_when", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS state FROM {orders}")
same("cast_types", "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS t, CAST(o_totalprice > 1000 AS INT) AS big, try_cast('12abc' AS INT) AS bad, CAST('42' AS BIGINT) AS good FROM {orders}", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS t, CAST(o_totalprice > 1000 AS INT) AS big, try_cast('12abc' AS INT) AS bad, CAST('42' AS BIGINT) AS good FROM orders")
same("int_div", "SELECT o_orderkey, o_custkey div 7 AS q, -o_custkey div 7 AS neg, o_custkey div nullif(o_custkey % 2, 0) AS maybe FROM {orders}", "SELECT o_orderkey, o_custkey // 7 AS q, -o_custkey // 7 AS neg, o_custkey // nullif(o_custkey % 2, 0) AS maybe FROM orders")
same("int_mod", "SELECT o_orderkey, o_custkey % 7 AS m, -o_custkey % 7 AS neg FROM {orders}")
same("exists_subquery", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
same("in_subquery", "SELECT c_custkey, c_name FROM {customer} WHERE c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)")

# Filters, with nulls where it matters
_ACCT = "(SELECT c_custkey, c_name, c_mktsegment, nullif(c_nationkey, 3) AS k, c_acctbal FROM {customer})"
same("filter_cmp", f"SELECT c_custkey FROM {_ACCT} t WHERE k >= 5 AND k <> 7 AND c_acctbal < 5000 AND c_mktsegment != 'BUILDING'")
same("filter_bool", f"SELECT c_custkey FROM {_ACCT} t WHERE NOT (k = 4 OR c_acctbal > 3000) AND (k < 20 OR k IS NULL)")
same("filter_null", f"SELECT c_custkey, k IS NULL AS missing FROM {_ACCT} t WHERE k IS NULL OR (k IS NOT NULL AND k = 1)")
same("filter_in", f"SELECT c_custkey FROM {_ACCT} t WHERE k IN (1, 3, 5, NULL)")
same("filter_not_in", f"SELECT c_custkey, k NOT IN (1, 2) AS outside, k NOT IN (1, NULL) AS unknown FROM {_ACCT} t WHERE k NOT IN (1, 2, 3)")
same("filter_between", f"SELECT c_custkey FROM {_ACCT} t WHERE k BETWEEN 3 AND 6 OR c_acctbal NOT BETWEEN 0 AND 9000")
same("filter_like", "SELECT p_partkey, p_type LIKE '%a_%' AS hit FROM {part} WHERE p_type LIKE 'S%' OR p_name NOT LIKE '%e%'")
same("filter_ilike", "SELECT p_partkey FROM {part} WHERE p_type ILIKE '%ST%' AND p_brand NOT ILIKE '%#1%'")

# Key ranges: filters reach the files' statistics
same("prune_eq", "SELECT * FROM {orders} WHERE o_orderkey = 96")
same("prune_in", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey IN (1, 32, 96, 1000000000)")
same("prune_range", "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderkey >= 100 AND o_orderkey < 400")

# Joins
for _kind in ("inner", "left", "right", "full"):
    same(f"join_{_kind}", f"SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM {{customer}} c {_kind.upper()} JOIN {{orders}} o ON c.c_custkey = o.o_custkey")
same("join_cross", "SELECT n.n_name, r.r_name FROM {nation} n CROSS JOIN {region} r")
same("join_residual", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c JOIN {orders} o ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 0 AND o.o_totalprice > 1000 AND (o.o_totalprice > 20 * c.c_acctbal OR c.c_mktsegment = 'BUILDING')")
same("join_order", "SELECT o.o_orderkey, n.n_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey ORDER BY n.n_name, o.o_orderkey")
same("semi_join", "SELECT c_custkey, c_name FROM {customer} LEFT SEMI JOIN {orders} ON c_custkey = o_custkey", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
same("anti_join", "SELECT c_custkey, c_name FROM {customer} LEFT ANTI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 250000", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")

# Aggregates; sums of money are exact, so that they don't depend on the order of rows
_MONEY = "CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"
_sum = lambda c: _MONEY.replace("{c}", c)
_big = lambda c: f"CAST(sum({c}) AS BIGINT)"
same("agg_count", "SELECT count(*) AS n, count(nullif(l_linenumber, 1)) AS some FROM {lineitem}")
same("agg_sum", f"SELECT {_sum('l_extendedprice')} AS price, {_big('l_linenumber')} AS lines FROM {{lineitem}}")
same("agg_avg", f"SELECT {_sum('l_quantity')} / count(l_quantity) AS mean FROM {{lineitem}}")
same("agg_min_max", "SELECT min(l_quantity) AS low, max(l_shipdate) AS late, min(l_returnflag) AS flag FROM {lineitem}")
same("agg_count_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT nullif(l_suppkey, 1)) AS suppliers FROM {lineitem}")
same("agg_sum_distinct", f"SELECT CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, min(DISTINCT l_linenumber) AS low, max(DISTINCT l_linenumber) AS high FROM {{lineitem}}")
same("agg_avg_distinct", "SELECT avg(DISTINCT l_linenumber) AS m FROM {lineitem}")
same("agg_empty", f"SELECT count(*) AS n, {_big('o_custkey')} AS s, max(o_orderkey) AS high, CAST(avg(o_custkey) AS DOUBLE) AS mean FROM {{orders}} WHERE o_orderkey < 0")
same("group_empty", "SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_orderkey < 0 GROUP BY o_orderstatus")
same("agg_expr_add", f"SELECT {_big('l_linenumber')} + 100 AS more, -count(*) AS minus FROM {{lineitem}}")
same("agg_expr_two", f"SELECT {_big('l_linenumber')} + count(*) AS both_, {_big('l_linenumber')} % count(*) AS rest FROM {{lineitem}}")
same("group_by", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_sum('l_quantity')} AS q FROM {{lineitem}} GROUP BY l_returnflag, l_linestatus")
same("group_by_expr", "SELECT o_custkey % 7 AS part, nullif(o_custkey % 3, 0) AS maybe, count(*) AS n FROM {orders} GROUP BY o_custkey % 7, nullif(o_custkey % 3, 0)")
same("having", f"SELECT o_custkey, count(*) AS n FROM {{orders}} GROUP BY o_custkey HAVING {_sum('o_totalprice')} > 300000 AND count(*) > 3")
same("group_agg_expr", f"SELECT l_returnflag, {_big('l_linenumber')} * 2 AS twice, {_big('l_linenumber')} - count(*) AS less FROM {{lineitem}} GROUP BY l_returnflag")
same("sum_length", "SELECT coalesce(sum(length(c_name)), 0) AS held, coalesce(sum(CASE WHEN c_custkey < 0 THEN length(c_name) END), 0) AS none FROM {customer}", "SELECT CAST(coalesce(sum(length(c_name)), 0) AS BIGINT) AS held, CAST(coalesce(sum(CASE WHEN c_custkey < 0 THEN length(c_name) END), 0) AS BIGINT) AS none FROM customer")

# Order, limit, sets
same("order_by", "SELECT o_custkey, o_orderkey FROM {orders} ORDER BY o_custkey DESC NULLS LAST, o_orderkey ASC NULLS FIRST")
same("limit_offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
same("union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey AS k FROM {supplier}")
same("union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}")
same("intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier}")
same("except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey AS k FROM {supplier} WHERE s_acctbal > 5000")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000 OR o_orderkey = 7")
def param_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered parameters out of order and repeated."""
    return dialect_query(spark, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = $2 AND o_totalprice > $1 OR o_orderkey = $2", [1000, 7], orders=table(spark, sf_dir, "orders"))


@query("SELECT * FROM customer WHERE contains(CAST(c_custkey AS VARCHAR), '13') OR contains(lower(c_name), '13') OR contains(CAST(c_nationkey AS VARCHAR), '13') OR contains(lower(c_mktsegment), '13')", name="any_field_contains")
def _any_field_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return customer.where(any_field_contains(customer.drop("c_acctbal"), "13"))


_RANGES = [("p1", None, 300), ("p2", 300, 900), ("p3", 900, None)]
_RANGE_SQL = "(VALUES ('p1', NULL, 300), ('p2', 300, 900), ('p3', 900, NULL)) AS m(partition_id, key_start, key_end)"


@query(f"SELECT o_orderkey, partition_id FROM orders JOIN {_RANGE_SQL} ON (key_start IS NULL OR o_orderkey >= key_start) AND (key_end IS NULL OR o_orderkey < key_end)")
def range_partition_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame(_RANGES, "partition_id string, key_start long, key_end long")
    return route(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", ranges)


@query("SELECT 'eq' AS shape, 'p2' AS reached UNION ALL SELECT 'in', 'p1,p3' UNION ALL SELECT 'range', 'p2,p3' UNION ALL SELECT 'between', 'p1,p2' UNION ALL SELECT 'scatter', 'p1,p2,p3'")
def prune_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partitions that predicate shapes reach."""
    tests = ["o_orderkey = 400 AND o_custkey = 1", "o_orderkey IN (1, 1000)", "o_orderkey > 500", "o_orderkey BETWEEN 10 AND 300", "o_orderkey = 1 OR o_custkey = 2"]
    found = [classify_predicate(t, "o_orderkey") for t in tests]
    return spark.createDataFrame([(r.shape, ",".join(partitions_reached(r, _RANGES))) for r in found], "shape string, reached string")


@query("SELECT o_orderkey, CASE WHEN nullif(o_orderkey, 5) IS NULL OR o_orderkey >= 700 THEN 'right' ELSE 'left' END AS side FROM orders")
def split_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", split_side(F.nullif(F.col("o_orderkey"), F.lit(5)), 700).alias("side"))


@query("SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_broadcast_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A side known to be within the broadcast limit (25 rows) is broadcast."""
    from ..operators.movement import size_in_bytes

    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    side = F.broadcast(nation) if size_in_bytes(nation) <= BROADCAST_LIMIT_BYTES else nation
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(side, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_name")


@query("SELECT o_orderstatus, arg_min(o_custkey, o_orderkey) AS o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus")
def bare_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns outside GROUP BY, from the row of the smallest key."""
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority")
    return select_star_with(orders, ["o_orderstatus"], ["o_orderkey"], F.count("*").alias("n")).drop("o_orderkey")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def chunked_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A streaming aggregation's batch twin: partial aggregates spill, rows aren't held."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT l_returnflag, l_linenumber AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linenumber) AS r FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE r = 1")
def agg_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mode(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag")


@query("SELECT CAST(sum(k) AS BIGINT) AS missing, CAST(0 AS BIGINT) AS empty FROM (SELECT CAST(NULL AS BIGINT) AS k FROM customer)", name="sum_or_null")
def _sum_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").withColumn("k", F.lit(None).cast("long"))
    return customers.agg(sum_or_null("k").alias("missing")).crossJoin(customers.where("c_custkey < 0").agg(sum_or_null("k").alias("empty")))
