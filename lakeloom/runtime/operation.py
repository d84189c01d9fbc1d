"""Functions beside the data: run per partition, reduce once; and the run context with its primitives."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.movement import GROUP_RECORDS, Broadcasts, lookup, place_in_order, size_in_bytes, with_continuation
from ..plans.classifier import classify
from ..plans.dialect import literal_statement, query
from .budgets import BudgetExceeded, Budgets, ResultStream, Telemetry, Token, bounded_rows, rows_in_batches, within_wall

#: Bounds of a distributed operation.
MAX_SHARD_ROWS, MAX_EMITS, MAX_PARTIALS = 4096, 64, 1024
#: Bytes of a shard when the size of a table decides.
SHARD_BYTES = 64 << 20


def shards_of(df: DataFrame, shard_bytes: int = SHARD_BYTES, least: int = 8) -> int:
    """Shards for a table of Catalyst's size estimate."""
    return max(least, -(-size_in_bytes(df) // shard_bytes))


def partials(df: DataFrame, key: list[str], shards: int | None, run: Callable, args: object = None, max_rows: int = MAX_SHARD_ROWS, max_emits: int = MAX_EMITS) -> DataFrame:
    """shard, key and partial emitted by run(rows, args, emit) over each shard of a range partitioning by key.

    Whole numbers come in the column whole instead, without a double's limit.
    Without a number of shards there are as many as the table's size calls for.

    A shard's rows reach run in batches of at most max_rows, so a shard of any
    size is worked through in bounded memory; run must give partials that add
    up over batches. A failing shard fails the job.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        for frame in frames:
            for at in range(0, len(frame), max_rows):
                out: list[tuple[int, str, float | None, Decimal | None]] = []

                def emit(k: str, value: float, out=out) -> None:
                    if len(out) >= max_emits:
                        raise BudgetExceeded(f"more than {max_emits} emits")
                    if not isinstance(k, str) or isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
                        raise ValueError("a partial is a text key and a finite number")
                    out.append((shard, k, None, Decimal(value)) if isinstance(value, int) else (shard, k, value, None))

                run(frame.iloc[at : at + max_rows].to_dict("records"), args, emit)
                yield pd.DataFrame(out, columns=["shard", "key", "partial", "whole"])

    dealt = df.repartitionByRange(shards or shards_of(df), *key)
    return dealt.mapInPandas(work, "shard int, key string, partial double, whole decimal(38,0)")


def distributed(df: DataFrame, key: list[str], run: Callable, reduce: Callable, args: object = None, shards: int | None = None, disjoint: bool = False, **bounds: int) -> object:
    """reduce(partials, args) over the shards' partials, combined by key on the way.

    With disjoint, a key emitted by two shards is an error. At most
    MAX_PARTIALS combined partials reach the driver; more are an error.
    """
    found = partials(df, key, shards, run, args, **bounds).groupBy("key").agg(F.sum("partial").alias("partial"), F.sum("whole").alias("whole"), F.count_distinct("shard").alias("shards"))
    rows = found.limit(MAX_PARTIALS + 1).collect()
    if len(rows) > MAX_PARTIALS:
        raise BudgetExceeded(f"more than {MAX_PARTIALS} partials")
    if disjoint and (twice := [r.key for r in rows if r.shards > 1]):
        raise ValueError(f"shards share keys: {', '.join(sorted(twice)[:5])}")
    return reduce({r.key: int(r.whole) if r.partial is None else r.partial + float(r.whole or 0) for r in rows}, args)


def staged(df: DataFrame, order: str, handler: Callable[[int, pd.DataFrame], pd.DataFrame], schema: str, batch: int = 1000, width: int = 4096) -> DataFrame:
    """handler(batch number, rows) for each batch of rows by a column of whole numbers, on executors.

    Every batch but the last has exactly batch rows, in order; results carry
    what handler gives them, so a batch number in schema puts them in order.
    """

    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("__place").drop(columns=["__place", "__batch"])
        return handler(int(key[0]), rows.reset_index(drop=True))

    numbered = place_in_order(df, order, width).withColumn("__batch", F.expr(f"__place div {batch}"))
    return numbered.groupBy("__batch").applyInPandas(work, schema)


def reduced(rows: DataFrame, key: str, order: list[str], handler: Callable[[object, pd.DataFrame, int, str | None], pd.DataFrame], schema: str, limit: int = GROUP_RECORDS) -> DataFrame:
    """handler(key, records, chunk, token) for each key, on executors, in chunks of at most limit records.

    token names the continuation and is None on a key's last chunk; so no key,
    however frequent, has to fit a task. Null keys are a group.
    """

    def work(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        token = frame["token"].iloc[0]
        records = frame.sort_values(order).drop(columns=["chunk", "token"]).reset_index(drop=True)
        return handler(group[0], records, int(group[1]), token)

    return with_continuation(rows, key, order, limit).groupBy(key, "chunk").applyInPandas(work, schema)


class Operation:
    """An authored operation: a literal statement over one table, run and reduce."""

    def __init__(self, statement: str, run: Callable, reduce: Callable):
        self.statement, self.run, self.reduce = literal_statement(statement), run, reduce

    def call(self, spark: SparkSession, key: list[str], args: object = None, shards: int | None = None) -> object:
        return distributed(spark.sql(self.statement), key, self.run, self.reduce, args, shards)


class Context:
    """What a run's function gets: calls, lookups, broadcasts, output, within budgets."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], budgets: Budgets, token: Token):
        self.spark, self.tables, self.budgets, self.token = spark, tables, budgets, token
        self.output, self.telemetry = ResultStream(budgets.rows, budgets.result_bytes), Telemetry()
        self.broadcasts, self.lineage = Broadcasts(spark), uuid.uuid4().hex
        self._done: dict[tuple[str, str], object] = {}
        self._nested = self._keys = self._depth = 0

    def frame(self, sql: str, params: list | None = None) -> DataFrame:
        return query(self.spark, sql, params, **self.tables)

    def call(self, sql: str, params: list | None = None, handler: Callable | None = None, batch: int = 1000):
        """Rows of a statement, lazily; or handler's result for each batch of rows, in order."""
        self.token.check()
        if self._depth:
            if classify(sql).classification != "BOUNDED":
                raise BudgetExceeded("a nested call must be bounded")
            self._nested += 1
            if self._nested > self.budgets.nested_calls:
                raise BudgetExceeded("too many nested calls")
            return bounded_rows(self.frame(sql, params), self.budgets, self.token)
        df = self.frame(sql, params)
        if handler is None:
            return self._iterate(df)
        out = []
        for rows in rows_in_batches(df, batch):
            self.token.check()
            self._depth += 1
            try:
                out.append(self.telemetry.timed("stage", lambda rows=rows: handler(rows, self)))
            finally:
                self._depth -= 1
        return out

    def _iterate(self, df: DataFrame):
        for row in df.toLocalIterator():
            self.token.check()
            yield row

    def lookup(self, table: str, keys: list[tuple[str, object]], allowed: list[str]) -> list:
        self._keys += len(keys)
        if self._keys > self.budgets.nested_keys:
            raise BudgetExceeded("too many keys looked up")
        return self.telemetry.timed("lookup", lambda: lookup(self.tables[table], keys, allowed), lambda rows: sum(len(json.dumps(r.asDict(), default=str)) for r in rows))

    def out(self, rows: list) -> dict:
        return self.output.push(rows)

    def once(self, stage: str, work: Callable):
        """work's result, stored under this run's lineage and the stage; a retry gives the stored one."""
        key = self.lineage, stage
        if key not in self._done:
            self._done[key] = work()
        return self._done[key]

    def cancel(self, reason: str = "cancelled") -> None:
        self.token.cancel(reason)


def run(spark: SparkSession, function: Callable, budgets: Budgets | None = None, **tables: DataFrame) -> object:
    """function(context) within budgets; with its output and telemetry if it put any out."""
    budgets, token = budgets or Budgets(), Token(spark)
    context = Context(spark, tables, budgets, token)
    result = within_wall(spark, token, budgets.wall_s, lambda: function(context))
    return {"result": result, "output": context.output.rows, "exceeded": context.output.exceeded, "telemetry": context.telemetry.seen} if context.output.rows or context.output.exceeded else result


class Registry:
    """Functions by name, run by the executor of their kind; an unknown kind fails."""

    def __init__(self):
        self.executors: dict[str, Callable] = {"python": lambda f, context, args: f(context, *args)}
        self.functions: dict[str, tuple[str, Callable]] = {}

    def register(self, name: str, function: Callable, kind: str = "python") -> None:
        if kind not in self.executors:
            raise ValueError(f"no executor for {kind}; there are: {', '.join(sorted(self.executors))}")
        self.functions[name] = kind, function

    def invoke(self, name: str, context: object = None, *args: object) -> object:
        if name not in self.functions:
            raise KeyError(name)
        kind, function = self.functions[name]
        return self.executors[kind](function, context, args)

    def query_with_callback(self, df: DataFrame, name: str, batch: int = 100) -> list:
        """The function's result for each batch of rows."""
        return [self.invoke(name, None, rows) for rows in rows_in_batches(df, batch)]

    def query_then_invoke(self, df: DataFrame, name: str, budgets: Budgets | None = None) -> object:
        """The function's result for all rows, within the result budget."""
        return self.invoke(name, None, bounded_rows(df, budgets or Budgets()))
