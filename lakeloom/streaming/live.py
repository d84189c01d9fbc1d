"""Live queries: standing predicates that give a snapshot and then insert, update and delete events."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import outside_literals, parse_live, translate
from ..plans.pruning import Reach, classify_predicate

TTL_S, MAX_PER_CLIENT, CURSOR_S = 30.0, 100, 300.0


class LiveQuery:
    """A parsed LIVE SELECT: table, columns, predicate."""

    def __init__(self, sql: str):
        select = parse_live(sql)
        m = re.fullmatch(r"SELECT\s+(.*?)\s+FROM\s+([\w.`\"]+)(?:\s+WHERE\s+(.*?))?(\s+ORDER\s+BY\s+.*?)?(\s+LIMIT\s+\d+)?", select, re.I | re.S)
        if not m:
            raise ValueError("a live query selects columns of one table")
        self.columns = [c.strip() for c in m[1].split(",")]
        self.table = m[2].strip('`"')
        self.where = m[3]

    @property
    def predicate(self) -> Column:
        """The WHERE clause as a Column, true without one; LIKE takes letters in either case."""
        if not self.where:
            return F.lit(True)
        return F.expr(translate(outside_literals(self.where, lambda t: re.sub(r"\bLIKE\b", "ILIKE", t, flags=re.I))))

    @property
    def signature(self) -> str:
        """The same for predicates whose conjuncts differ in order only: such queries share a stream."""
        parts = sorted(re.sub(r"\s+", " ", p.strip()) for p in re.split(r"\bAND\b", self.where, flags=re.I)) if self.where and not re.search(r"\b(OR|BETWEEN)\b", self.where, re.I) else [re.sub(r"\s+", " ", self.where or "")]
        return hashlib.sha256(repr((self.table.lower(), parts)).encode()).hexdigest()

    def reach(self, key: str) -> Reach:
        """Which keys the predicate can meet."""
        return classify_predicate(self.where, key)

    def snapshot(self, df: DataFrame) -> DataFrame:
        """The rows that match now, as snapshot events."""
        rows = df.where(self.predicate)
        return (rows if self.columns == ["*"] else rows.select(*self.columns)).withColumn("event", F.lit("snapshot"))


def event_of(old_match: Column, new_match: Column) -> Column:
    """insert, update, delete or null from whether a row matched before and matches now."""
    old, new = F.coalesce(old_match, F.lit(False)), F.coalesce(new_match, F.lit(False))
    return F.when(~old & new, "insert").when(old & new, "update").when(old & ~new, "delete")


def transitions(changes: DataFrame, key: str, order: list[str], predicate: Column, operation: str = "operation") -> DataFrame:
    """The batch twin: each change with its live event, from the row's state before; changes without one are left out."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    matched = changes.withColumn("__new", F.coalesce(predicate, F.lit(False)) & (F.col(operation) != "DELETE"))
    return matched.withColumn("event", event_of(F.lag("__new").over(w), F.col("__new"))).where("event IS NOT NULL").drop("__new")


def stream_events(changes: DataFrame, key: str, order: str, predicate: Column, operation: str = "operation") -> DataFrame:
    """Live events of a stream: key, event and order, with each key's last match kept as state.

    changes must hold key, order (comparable, kept as bigint) and operation.
    State is one flag for each key seen; a delete drops it.
    """
    flagged = changes.select(F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("at"), (F.coalesce(predicate, F.lit(False)) & (F.col(operation) != "DELETE")).alias("match"))

    def step(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        matched = bool(state.get[0]) if state.exists else False
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        out = []
        for at, new in zip(rows["at"], rows["match"], strict=True):
            event = ("update" if new else "delete") if matched else ("insert" if new else None)
            if event:
                out.append((group[0], int(at), event))
            matched = bool(new)
        if matched:
            state.update((matched,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "at", "event"])

    return flagged.groupBy("key").applyInPandasWithState(step, "key string, at bigint, event string", "matched boolean", "append", "NoTimeout")


def event_rate(events: DataFrame, at: str, width: str, *group: str) -> DataFrame:
    """Events per tumbling window."""
    return events.groupBy(F.window(at, width).alias("w"), *group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *group, "n")


class Subscriptions:
    """Standing queries by client, with time to live, renewal, and one shared stream per signature."""

    def __init__(self, ttl_s: float = TTL_S, max_per_client: int = MAX_PER_CLIENT, clock: Callable[[], float] = time.monotonic):
        self.ttl_s, self.most, self.clock = ttl_s, max_per_client, clock
        self.held: dict[str, tuple[str, LiveQuery, float, int]] = {}
        self._n = 0

    def subscribe(self, client: str, sql: str) -> str:
        query = LiveQuery(sql)
        self.expire()
        if sum(c == client for c, *_ in self.held.values()) >= self.most:
            raise ValueError("too many live queries of one client")
        self._n += 1
        name = f"live-{self._n}"
        self.held[name] = client, query, self.clock() + self.ttl_s, 0
        return name

    def renew(self, name: str, cursor: int, oldest: int = 0) -> str:
        """"resumed" from the cursor, or "resync" if events behind it are gone."""
        client, query, _, _ = self.held[name]
        self.held[name] = client, query, self.clock() + self.ttl_s, cursor
        return "resync" if cursor < oldest else "resumed"

    def expire(self) -> list[str]:
        gone = [k for k, v in self.held.items() if v[2] <= self.clock()]
        for k in gone:
            del self.held[k]
        return gone

    def groups(self) -> dict[str, list[str]]:
        """Signature → the queries that share its stream."""
        out: dict[str, list[str]] = {}
        for name, (_, query, *_rest) in self.held.items():
            out.setdefault(query.signature, []).append(name)
        return out
