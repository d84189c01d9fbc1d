"""Moving data to data: the choice between broadcast, lookup and shuffle, and the keyed exchanges."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_LIMIT_BYTES

STRATEGIES = ("broadcast", "lookup", "emit_shuffle")
#: Access paths that bound a lookup by its keys.
KEY_PATHS = ("pk", "unique", "bounded")
LOOKUP_MAX_KEYS, LOOKUP_MAX_BYTES = 1000, 1 << 20
EMIT_MAX_BYTES = 16 << 20
EXCHANGE_BUCKETS = 16
GROUP_RECORDS = 10_000


class Decision(NamedTuple):
    strategy: str
    reason: str
    hinted: bool = False


def decide(side_bytes: int, access_path: str | None = None, hint: str | None = None, limit: int = BROADCAST_LIMIT_BYTES) -> Decision:
    """How to bring a side to the other; a hint that breaks a bound is an error."""
    if not isinstance(side_bytes, int) or side_bytes < 0:
        raise ValueError("a side's size in bytes is needed")
    if hint is not None:
        if hint not in STRATEGIES:
            raise ValueError(f"unknown strategy {hint}")
        if hint == "broadcast" and side_bytes > limit:
            raise ValueError("the side is too large to broadcast")
        if hint == "lookup" and access_path not in KEY_PATHS:
            raise ValueError("no access path bounds the lookup")
        return Decision(hint, "hint", True)
    if side_bytes <= limit:
        return Decision("broadcast", "fits the limit")
    return Decision("lookup", "bounded by keys") if access_path in KEY_PATHS else Decision("emit_shuffle", "too large, no bounded path")


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_by_decision(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", access_path: str | None = None, hint: str | None = None) -> tuple[DataFrame, Decision]:
    """The join and the decision taken for its right side, broadcast only if its estimated size allows."""
    made = decide(size_in_bytes(right), access_path, hint)
    side = right.hint("broadcast") if made.strategy == "broadcast" else right.hint("merge") if made.strategy == "emit_shuffle" else right
    return left.join(side, on, how), made


def strategy_column(side_bytes: Column, access_path: Column, hint: Column, limit: int = BROADCAST_LIMIT_BYTES) -> Column:
    """decide() over rows; an invalid hint gives "rejected"."""
    keyed = F.coalesce(access_path.isin(*KEY_PATHS), F.lit(False))
    allowed = F.when(hint == "broadcast", side_bytes <= limit).when(hint == "lookup", keyed).otherwise(hint == "emit_shuffle")
    default = F.when(side_bytes <= limit, "broadcast").when(keyed, "lookup").otherwise("emit_shuffle")
    return F.when(hint.isNull(), default).when(allowed, hint).otherwise("rejected")


def lookup(table: DataFrame, keys: list[tuple[str, object]], allowed: list[str], max_keys: int = LOOKUP_MAX_KEYS, max_bytes: int = LOOKUP_MAX_BYTES) -> list:
    """Rows that match any (column, value) key, within the bounds; an error beyond them."""
    distinct = list(dict.fromkeys(keys))
    if not distinct or len(distinct) > max_keys:
        raise ValueError(f"1 to {max_keys} keys are looked up at once")
    if bad := {c for c, _ in distinct} - set(allowed):
        raise ValueError(f"no access path for {', '.join(sorted(bad))}")
    cond = None
    for column in dict.fromkeys(c for c, _ in distinct):
        part = F.col(column).isin([v for c, v in distinct if c == column])
        cond = part if cond is None else cond | part
    out, size = [], 0
    for row in table.where(cond).toLocalIterator():
        size += len(json.dumps(row.asDict(), default=str))
        if size > max_bytes:
            raise ValueError("the lookup's result is too large")
        out.append(row)
    return out


def lookup_join(table: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of table whose key is among keys: each once, whatever repeats keys hold; Spark picks how."""
    return table.join(keys.select(on).distinct(), on, "left_semi")


class Broadcasts:
    """Named, versioned small values for executors, bounded in JSON size."""

    def __init__(self, spark, limit: int = BROADCAST_LIMIT_BYTES):
        self.spark, self.limit, self._held = spark, limit, {}

    def publish(self, name: str, value: object) -> int:
        size = len(json.dumps(value, default=str).encode())
        if size > self.limit:
            raise ValueError(f"{size} bytes; {self.limit} may be broadcast")
        version = self._held[name][0] + 1 if name in self._held else 1
        self._held[name] = version, self.spark.sparkContext.broadcast(value)
        return version

    def use(self, name: str):
        if name not in self._held:
            raise KeyError(name)
        return self._held[name][1]

    def version(self, name: str) -> int:
        return self._held[name][0]

    def delete(self, name: str) -> bool:
        held = self._held.pop(name, None)
        if held:
            held[1].unpersist()
        return held is not None

    def __contains__(self, name: str) -> bool:
        return name in self._held


def bucket_of(key: Column, buckets: int = EXCHANGE_BUCKETS) -> Column:
    """The exchange bucket of a text key: its 32-bit FNV-1a hash over UTF-16 units, modulo buckets (in the JVM)."""
    start, prime, mod = 2166136261, 16777619, 1 << 32
    units = F.regexp_extract_all(F.hex(F.encode(key, "UTF-16BE")), F.lit("(....)"), 1)
    hashed = F.aggregate(units, F.lit(start).cast("long"), lambda h, u: (h.bitwiseXOR(F.conv(u, 16, 10).cast("long")) * prime) % mod)
    return (hashed % buckets).cast("int")


def emitted_within(rows: DataFrame, key: str, value: str, limit: int | None = EMIT_MAX_BYTES) -> DataFrame:
    """rows, if keys and values are all set and their bytes stay within the limit, if there is one; else an error."""
    got = rows.agg(F.sum(F.octet_length(key) + F.octet_length(value)).alias("bytes"), F.count_if(F.col(key).isNull() | F.col(value).isNull()).alias("nulls")).first()
    if got.nulls:
        raise ValueError("an emitted key or value is null")
    if limit is not None and (got.bytes or 0) > limit:
        raise ValueError(f"{got.bytes} bytes emitted; the limit is {limit}")
    return rows


def reduce_by_key(rows: DataFrame, key: str, *aggs: Column) -> DataFrame:
    """Records combined by key; built-in aggregates combine before they are shuffled."""
    return rows.groupBy(key).agg(*aggs)


def with_continuation(rows: DataFrame, key: str, order: list[str], limit: int = GROUP_RECORDS) -> DataFrame:
    """rows with chunk (0-based, limit records each) and token: key-chunk-i on all chunks of a key but its last.

    A window streams over a key's sorted rows and spills; it gathers none.
    """
    w = Window.partitionBy(key)
    numbered = rows.withColumn("chunk", F.floor((F.row_number().over(w.orderBy(*order)) - 1) / limit).cast("int"))
    last = rows.groupBy(F.col(key).alias("__k")).agg(F.floor((F.count("*") - 1) / limit).cast("int").alias("__last"))
    token = F.when(F.col("chunk") < F.col("__last"), F.concat(F.col(key).cast("string"), F.lit("-chunk-"), F.col("chunk").cast("string")))
    return numbered.join(last, F.col(key).eqNullSafe(F.col("__k"))).withColumn("token", token).drop("__k", "__last")


def place_in_order(rows: DataFrame, order: str, width: int = 4096) -> DataFrame:
    """rows with __place: their 0-based place by a column of whole numbers, nulls first, ties in any order.

    Places come from counts per range of width keys and per 4096 such ranges,
    so a task ranks one range's rows and no task sees all ranges.
    """
    wide = F.floor(F.col(order) / width).cast("long")
    far = F.floor(F.col("__range") / 4096).cast("long")
    counts = rows.groupBy(wide.alias("__range")).agg(F.count("*").alias("__n")).withColumn("__far", far)
    fars = counts.groupBy("__far").agg(F.sum("__n").alias("__all")).selectExpr("__far AS __f", "sum(__all) OVER (ORDER BY __far) - __all AS __before")
    near = counts.withColumn("__in", F.expr("sum(__n) OVER (PARTITION BY __far ORDER BY __range) - __n"))
    starts = near.join(fars, F.col("__far").eqNullSafe(F.col("__f"))).select(F.col("__range").alias("__r"), (F.col("__before") + F.col("__in")).alias("__base"))
    ranked = rows.withColumn("__range", wide).withColumn("__k", F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1)
    placed = ranked.join(starts, F.col("__range").eqNullSafe(F.col("__r")))
    return placed.withColumn("__place", F.col("__base") + F.col("__k")).drop("__range", "__k", "__r", "__base")


def dedupe_lineage(rows: DataFrame, order: list[str], lineage: str = "lineage_id", stage: str = "stage_id") -> DataFrame:
    """One row of each (lineage, stage): the first in order; a retry gives what was stored."""
    others = [c for c in rows.columns if c not in (lineage, stage)]
    best = F.min_by(F.struct(*others), F.struct(*order)).alias("__first")
    return rows.groupBy(lineage, stage).agg(best).select(lineage, stage, "__first.*")
