"""Change events: classification, last-writer-wins state, back-fill, deduplication; batch and streaming."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks rows of a merged table whose key was deleted; they keep the delete's stamp against later, older changes.
TOMBSTONE = "_deleted"
OPERATIONS = ("INSERT", "UPDATE", "DELETE", "UPSERT")


def operation_of(sql: str) -> str | None:
    """The change a statement makes, by its first word; INSERT OR REPLACE is an INSERT."""
    m = re.match(r"\s*(insert|update|delete|upsert)\b", sql, re.I)
    return m[1].upper() if m else None


def operation_column(sql: Column) -> Column:
    """operation_of() over rows."""
    word = F.upper(F.regexp_extract(sql, r"(?i)^\s*(insert|update|delete|upsert)\b", 1))
    return F.when(word != "", word)


def latest(changes: DataFrame, key: list[str], stamp: str, *tie: str) -> DataFrame:
    """The newest change of each key. Equal stamps are settled by tie, greatest last."""
    order = F.struct(stamp, *tie) if tie else F.col(stamp)
    row = F.max_by(F.struct(*(c for c in changes.columns if c not in key)), order).alias("__row")
    return changes.groupBy(*key).agg(row).select(*key, "__row.*")


def apply_changes(changes: DataFrame, key: list[str], stamp: str, *tie: str, operation: str = "operation") -> DataFrame:
    """The table after all changes: newest rows, without deleted keys."""
    return latest(changes, key, stamp, *tie).where(F.col(operation) != "DELETE")


def merge_into(table: DataFrame, changes: DataFrame, key: list[str], stamp: str, operation: str = "operation") -> DataFrame:
    """A stamped table after changes: a change that is older than its row is stale; an equal one isn't.

    Null fields of the winner are filled from the loser (a shallow merge).
    Deleted keys stay as tombstones with their stamps, so that a change that
    comes late doesn't bring them back; current() leaves them out. Both sides
    are combined per key before any row moves on.
    """
    values = [c for c in table.columns if c not in (*key, stamp, TOMBSTONE)]
    gone = F.col(TOMBSTONE) if TOMBSTONE in table.columns else F.lit(False)
    old = table.withColumn(operation, F.when(gone, "DELETE").otherwise("UPSERT")).withColumn("__new", F.lit(0))
    rows = old.drop(TOMBSTONE).unionByName(changes.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = F.struct(stamp, "__new")
    filled = [F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(operation) != "DELETE"), order)).alias(c) for c in values]
    out = rows.groupBy(*key).agg(F.max(stamp).alias(stamp), F.max_by(operation, order).alias("__last"), *filled)
    deleted = F.col("__last") == "DELETE"
    kept = (F.when(~deleted, F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns if c != TOMBSTONE)
    return out.select(*kept, deleted.alias(TOMBSTONE))


def current(table: DataFrame) -> DataFrame:
    """A merged table's rows without tombstones."""
    return table.where(~F.col(TOMBSTONE)).drop(TOMBSTONE) if TOMBSTONE in table.columns else table


def backfill(changes: DataFrame, key: list[str], stamp: str, columns: list[str]) -> DataFrame:
    """For each key the newest non-null value of every column."""
    return changes.groupBy(*key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(stamp))).alias(c) for c in columns))


def dedupe(changes: DataFrame, identity: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """Each event once; on a stream within the watermark (column, delay), which bounds the state."""
    if changes.isStreaming:
        if watermark is None:
            raise ValueError("a stream needs a watermark to forget events")
        return changes.withWatermark(*watermark).dropDuplicatesWithinWatermark(identity)
    return changes.dropDuplicates(identity)


def coalesce_latest(changes: DataFrame, table: str, key: str, stamp: str, capacity: int | None = None) -> DataFrame:
    """One event per table and key, the newest; with capacity only that many newest of all."""
    out = latest(changes, [table, key], stamp)
    return out if capacity is None else out.orderBy(F.desc(stamp), table, key).limit(capacity)


def as_of(changes: DataFrame, key: list[str], stamp: str, at: Column, operation: str = "operation") -> DataFrame:
    """The table as it was at a stamp."""
    return apply_changes(changes.where(F.col(stamp) <= at), key, stamp, operation=operation)


class EventBuffer:
    """Change events held on the driver until a subscriber takes them: at most capacity, the oldest drop out.

    Of a table in coalesced only the newest event of each key is held, in the
    newest one's place. recent has the last events seen, sent or not.
    """

    def __init__(self, key: str, coalesced: frozenset[str] | set[str] = frozenset(), capacity: int = 1000, recent: int = 256):
        self.key, self.coalesced, self.capacity, self.dropped = key, coalesced, capacity, 0
        self.recent: deque = deque(maxlen=recent)
        self._held: dict[tuple, dict] = {}
        self._number = 0

    def __len__(self) -> int:
        return len(self._held)

    def put(self, event: dict) -> bool:
        """Hold an event; false if an older one had to go."""
        self.recent.append(event)
        self._number += 1
        value = event.get("data", {}).get(self.key)
        place = (event["table"], value) if event["table"] in self.coalesced and value is not None else (self._number,)
        self._held.pop(place, None)
        full = len(self._held) >= self.capacity
        if full:
            del self._held[next(iter(self._held))]
            self.dropped += 1
        self._held[place] = event
        return not full

    def replay(self, send: Callable[[dict], None], delivered: set | None = None) -> int:
        """Send what is held, in order, each event once; after an error the event and those behind it stay held."""
        seen = set() if delivered is None else delivered
        sent = 0
        while self._held:
            place, event = next(iter(self._held.items()))
            identity = event["table"], event["operation"], event.get("data", {}).get(self.key), event["timestamp"]
            if identity not in seen:
                send(event)
                seen.add(identity)
                sent += 1
            if self._held.get(place) is event:
                del self._held[place]
        return sent


def start_merge(stream: DataFrame, snapshots, key: list[str], stamp: str, checkpoint: str, operation: str = "operation", **trigger):
    """Keep a versioned table (operators.dml.Snapshots) merged with a stream of changes.

    Each micro-batch reads the newest version and publishes the next, which
    current() reads. The merge is idempotent, so a batch that is run again
    changes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            snapshots.commit(merge_into(snapshots.read(), batch, key, stamp, operation))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
