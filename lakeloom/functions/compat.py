"""Scalar functions of the PostgreSQL/SQLite-flavoured dialect, as Columns; all stay inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"
TRUNC_PARTS = ("year", "month", "day", "hour", "minute", "second")
EXTRACT_PARTS = ("year", "month", "day", "hour", "minute", "second", "dow", "doy", "epoch")


def concat(*parts: Column) -> Column:
    """Concatenation; null if any part is (also the || operator)."""
    return F.concat(*parts)


def substr(text: Column, start: int, length: int | None = None) -> Column:
    """1-based substring; position 0 is one before the first character, so it takes up a place of length."""
    if start == 0:
        return F.substring(text, 1, 2**31 - 1) if length is None else F.substring(text, 1, max(length - 1, 0))
    return F.substring(text, start, 2**31 - 1 if length is None else length)


def extract(part: str, at: Column) -> Column:
    """An integer field of a timestamp; Sunday is day 0 of the week."""
    name = part.lower()
    if name not in EXTRACT_PARTS:
        raise ValueError(f"no field {part} to extract; fields: {', '.join(EXTRACT_PARTS)}")
    if name == "dow":
        return F.dayofweek(at) - 1
    if name == "doy":
        return F.dayofyear(at)
    if name == "epoch":
        return F.unix_timestamp(at.cast("timestamp"))
    return {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}[name](at)


def date_trunc_text(part: str, at: Column) -> Column:
    """A timestamp cut to part, as YYYY-MM-DD HH:MM:SS text."""
    if part.lower() not in TRUNC_PARTS:
        raise ValueError(f"no part {part} to cut to; parts: {', '.join(TRUNC_PARTS)}")
    return F.date_format(F.date_trunc(part, at), TEXT_FORMAT)


def now_text() -> Column:
    return F.date_format(F.current_timestamp(), TEXT_FORMAT)


def current_time_text() -> Column:
    return F.date_format(F.current_timestamp(), "HH:mm:ss")


def int_div(a: Column, b: Column) -> Column:
    """Integer division towards zero; null for a zero divisor."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def int_mod(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; null for a zero divisor."""
    return a % F.nullif(b, F.lit(0))


def spark_type(kind: str) -> str:
    """Spark's type for a declared one, by affinity."""
    affinity = {
        "integer": "bigint", "int": "bigint", "bigint": "bigint", "smallint": "bigint", "tinyint": "bigint", "serial": "bigint", "bigserial": "bigint", "boolean": "boolean",
        "varchar": "string", "text": "string", "char": "string", "character varying": "string",
        "real": "double", "double precision": "double", "double": "double", "float": "double", "numeric": "double", "decimal": "double", "bytea": "binary",
    }
    name = kind.split("(")[0].strip().lower()
    if name not in affinity:
        raise ValueError(f"unknown type {kind}")
    return affinity[name]


def lenient_cast(x: Column, kind: str) -> Column:
    """Cast by affinity; null where the value can't be read as the type."""
    return x.try_cast(spark_type(kind))


def any_field_contains(df: DataFrame, needle: str) -> Column:
    """Whether any column's text holds needle, letters in either case."""
    low = F.lit(needle.lower())
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c).cast("string")), low), F.lit(False)) for c in df.columns))
