"""Aggregates that need a rule beyond Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def bare(column: str, *key: str) -> Column:
    """A column outside GROUP BY: its value in the group's row of the smallest key."""
    by = F.col(key[0]) if len(key) == 1 else F.struct(*key)
    return F.min_by(column, by)


def select_star_with(df: DataFrame, group: list[str], key: list[str], *aggs: Column) -> DataFrame:
    """Aggregates beside every column, bare columns taken from the row of the smallest key."""
    others = [bare(c, *key).alias(c) for c in df.columns if c not in group]
    return df.groupBy(*group).agg(*others, *aggs) if group else df.agg(*others, *aggs)


def mode(df: DataFrame, column: str, *group: str) -> DataFrame:
    """group columns, mode and its count n: the most frequent non-null value, the smallest of equals.

    Values are counted first, so a frequent value is one row per task.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct(F.col(column).alias("mode"), "n"), F.struct(-F.col("n"), F.col(column))).alias("best")
    return (counts.groupBy(*group) if group else counts).agg(best).select(*group, "best.mode", "best.n")


def sum_or_null(column: str) -> Column:
    """0 without rows; null if there are rows and no value among them."""
    return F.when(F.count("*") == 0, F.lit(0)).otherwise(F.sum(column))


def exact_sum(column: Column | str, scale: int = 2) -> Column:
    """A sum of money-like doubles that doesn't depend on the order of rows."""
    return F.sum(F.col(column).cast(f"decimal(18,{scale})") if isinstance(column, str) else column.cast(f"decimal(18,{scale})")).cast("double")


def rate_per_minute(df: DataFrame, counter: str, at_ms: str, *group: str) -> DataFrame:
    """df with per_minute: a counter's growth since the row before, 0 at first or without growth or time."""
    w = Window.partitionBy(*group).orderBy(at_ms, counter)
    grown, passed = F.col(counter) - F.lag(counter).over(w), F.col(at_ms) - F.lag(at_ms).over(w)
    return df.withColumn("per_minute", F.when((grown > 0) & (passed > 0), grown * F.lit(60000.0) / passed).otherwise(F.lit(0.0)))


def numeric_aware(column: str, descending: bool = False) -> list[Column]:
    """Sort keys for text that may be numbers: numbers by value, then other text, nulls last either way."""
    text = F.col(column).cast("string")
    number = F.trim(text).try_cast("double")
    if descending:
        return [text.isNull(), number.isNotNull(), number.desc(), text.desc()]
    return [text.isNull(), number.isNull(), number.asc(), text.asc()]


class ChunkStats:
    """Rows, bytes (as JSON) and chunks that pass through a frame, counted by the job that reads it."""

    def __init__(self, chunk: int = 1000):
        self.chunk = chunk
        self.reset()

    def reset(self) -> None:
        self._seen = Observation()

    def watch(self, df: DataFrame) -> DataFrame:
        size = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))).cast("long")
        return df.observe(self._seen, F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"))

    def get(self) -> dict[str, int]:
        """Once a job has read the frame; it waits for one."""
        rows, size = self._seen.get["rows"], self._seen.get["bytes"] or 0
        return {"total_rows": rows, "estimated_bytes": size, "chunk_count": -(-rows // self.chunk)}
