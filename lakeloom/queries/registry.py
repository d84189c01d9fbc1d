"""Name → builder and name → DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under its function's name, with the SQL that must give the same rows."""

    def add(build: Builder) -> Builder:
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"two queries named {key}")
        QUERIES[key] = build
        if sql:
            ORACLES[key] = sql
        return build

    return add
