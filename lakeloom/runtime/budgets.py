"""Budgets, cancellation and telemetry of a run, on the driver; work itself stays in Spark jobs."""

from __future__ import annotations

import json
import statistics
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F


class BudgetExceeded(RuntimeError):
    """A run went beyond one of its bounds."""


class Cancelled(RuntimeError):
    """The run's token was cancelled."""


@dataclass
class Budgets:
    """Default bounds of a run."""

    wall_s: float = 30.0
    rows: int = 100_000
    result_bytes: int = 8 << 20
    nested_calls: int = 1000
    nested_keys: int = 10_000
    emit_bytes: int = 16 << 20


@dataclass
class Token:
    """Cancellation that reaches children and, through a job group, Spark's jobs."""

    spark: object = None
    group: str = field(default_factory=lambda: uuid.uuid4().hex)
    reason: str | None = None
    children: list = field(default_factory=list)

    def child(self) -> Token:
        made = Token(self.spark, reason=self.reason)
        self.children.append(made)
        return made

    def cancel(self, reason: str = "cancelled") -> None:
        self.reason = self.reason or reason
        if self.spark is not None:
            self.spark.sparkContext.cancelJobGroup(self.group)
        for c in self.children:
            c.cancel(reason)

    def check(self) -> None:
        if self.reason:
            raise Cancelled(self.reason)


def within_wall(spark, token: Token, seconds: float, work: Callable):
    """Run work in the token's job group; its jobs are cancelled at the deadline."""
    spark.sparkContext.setJobGroup(token.group, "bounded run", True)
    timer = threading.Timer(seconds, lambda: token.cancel(f"over {seconds} s"))
    timer.start()
    try:
        out = work()
        token.check()
        return out
    except Exception as e:
        if token.reason:
            raise BudgetExceeded(token.reason) from e
        raise
    finally:
        timer.cancel()


def bounded_rows(df: DataFrame, budgets: Budgets, token: Token | None = None) -> list[Row]:
    """All rows, or an error (never a truncation) beyond the bounds; at most one row too many is computed."""
    out, size = [], 0
    for row in df.limit(budgets.rows + 1).toLocalIterator():
        token and token.check()
        size += len(json.dumps(row.asDict(True), default=str))
        if len(out) >= budgets.rows or size > budgets.result_bytes:
            raise BudgetExceeded(f"more than {budgets.rows} rows or {budgets.result_bytes} bytes")
        out.append(row)
    return out


class ResultStream:
    """Accepted output rows: a prefix within the bounds, and whether more was offered."""

    def __init__(self, max_rows: int = 100_000, max_bytes: int = 8 << 20):
        self.max_rows, self.max_bytes = max_rows, max_bytes
        self.rows: list = []
        self.bytes, self.exceeded = 0, False

    def push(self, rows: list) -> dict:
        accepted = 0
        for row in rows:
            size = len(json.dumps(row, default=str))
            if self.exceeded or len(self.rows) >= self.max_rows or self.bytes + size > self.max_bytes:
                self.exceeded = True
                break
            self.rows.append(row)
            self.bytes += size
            accepted += 1
        return {"accepted": accepted, "total_rows": len(self.rows), "total_bytes": self.bytes, "exceeded": self.exceeded}


def prefix_within(df: DataFrame, order: list[str], size, max_rows: int, max_bytes: int) -> DataFrame:
    """The longest prefix, in order, of at most max_rows rows and max_bytes of size.

    The limit comes first, so only max_rows rows reach the running sum.
    """
    head = df.orderBy(*order).limit(max_rows)
    return head.withColumn("total_bytes", F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("total_bytes") <= max_bytes)


class Telemetry:
    """Count, bytes and least and greatest duration of each primitive."""

    def __init__(self):
        self.seen: dict[str, list[float]] = {}

    def record(self, primitive: str, seconds: float, n_bytes: int = 0) -> None:
        count, total, low, high = self.seen.get(primitive, (0, 0, float("inf"), 0.0))
        self.seen[primitive] = [count + 1, total + n_bytes, min(low, seconds), max(high, seconds)]

    def timed(self, primitive: str, work: Callable, size: Callable[[object], int] | None = None):
        """work's result, with its time and, by size(result), its bytes."""
        began = time.monotonic()
        out = work()
        self.record(primitive, time.monotonic() - began, size(out) if size else 0)
        return out


class AccessCounts:
    """Reads and writes counted by service and partition; a snapshot that couldn't be delivered is merged back."""

    KINDS = ("read", "write")

    def __init__(self):
        self.counts: Counter[tuple[str, str, str]] = Counter()

    def record(self, service: str, partitions: list[str], kind: str) -> None:
        """Count an access to each partition; without a service, or of another kind, none."""
        if service and kind in self.KINDS:
            self.counts.update((service, p, kind) for p in partitions if p)

    def snapshot(self) -> Counter:
        """What was counted; counting starts anew."""
        out, self.counts = self.counts, Counter()
        return out

    def merge(self, snapshot: Counter | None) -> None:
        self.counts += Counter(snapshot or {})

    def frame(self, spark) -> DataFrame:
        """service, part, read and write of every pair seen."""
        pairs = sorted({(s, p) for s, p, _ in self.counts})
        rows = [(s, p, *(self.counts[s, p, k] for k in self.KINDS)) for s, p in pairs]
        return spark.createDataFrame(rows, "service string, part string, read long, write long")


def stragglers(latencies: dict[str, float], factor: float = 2.0, floor: float = 0.0) -> list[tuple[str, float]]:
    """(name, excess) of those slower than factor times the median, most first; none before two are known."""
    if len(latencies) < 2:
        return []
    limit = max(factor * statistics.median(latencies.values()), floor)
    return sorted(((k, v - limit) for k, v in latencies.items() if v > limit), key=lambda x: (-x[1], x[0]))


def rows_in_batches(df: DataFrame, size: int) -> Iterator[list[Row]]:
    """Rows in lists of size, streamed a partition at a time."""
    held = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
