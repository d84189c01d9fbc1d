"""Table definitions with keys and defaults, system tables over them, and keyed reads of small tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, DoubleType, LongType, StringType, StructField, StructType

# Declared types by storage class.
_CLASSES: dict[str, tuple[str, ...]] = {
    "INTEGER": ("INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT", "BOOLEAN", "BOOL"),
    "TEXT": ("VARCHAR", "CHAR", "NVARCHAR", "NCHAR", "CLOB", "TEXT", "DATETIME", "TIMESTAMP", "DATE", "TIME"),
    "REAL": ("FLOAT", "DOUBLE", "DECIMAL", "NUMERIC", "REAL"),
    "BLOB": ("BLOB", "BYTEA"),
}
_SPARK: dict[str, DataType] = {"INTEGER": LongType(), "TEXT": StringType(), "REAL": DoubleType(), "BLOB": BinaryType()}


def storage_class(declared: str) -> str:
    """The storage class of a declared type; an unknown type keeps its name in capitals."""
    name = re.sub(r"\(.*\)", "", declared).strip().upper()
    return next((c for c, names in _CLASSES.items() if name in names), name)


@dataclass
class Table:
    """A table's columns (name, declared type, options) and key."""

    name: str
    columns: list[tuple[str, str, dict]]
    key: list[str]
    options: dict[str, str] = field(default_factory=dict)

    @property
    def schema(self) -> StructType:
        return StructType(
            [StructField(n, _SPARK.get(storage_class(t), StringType()), not (o.get("not_null") or n in self.key), {"primaryKey": n in self.key, "unique": bool(o.get("unique")), **({"default": o["default"]} if "default" in o else {})}) for n, t, o in self.columns]
        )


def parse_create_table(sql: str) -> Table:
    """A CREATE TABLE statement; a primary key is needed."""
    m = re.fullmatch(r"\s*CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.]+)\s*\((.*?)\)\s*(?:WITH\s*\((.*?)\))?\s*;?\s*", sql, re.I | re.S)
    if not m:
        raise ValueError("not a CREATE TABLE statement")
    columns, key = [], []
    for part in re.split(r",(?![^(]*\))", m[2]):
        part = part.strip()
        if k := re.fullmatch(r"PRIMARY\s+KEY\s*\((.*)\)", part, re.I):
            key = [c.strip() for c in k[1].split(",")]
            continue
        c = re.fullmatch(r"(\w+)\s+(\w+(?:\s*\([^)]*\))?)(.*)", part, re.S)
        if not c:
            raise ValueError(f"can't read column {part!r}")
        rest = c[3]
        options = {"not_null": bool(re.search(r"\bNOT\s+NULL\b", rest, re.I)), "unique": bool(re.search(r"\bUNIQUE\b", rest, re.I))}
        if d := re.search(r"\bDEFAULT\s+('(?:[^']|'')*'|\S+)", rest, re.I):
            value = d[1]
            options["default"] = value[1:-1].replace("''", "'") if value[0] == "'" else {"TRUE": 1, "FALSE": 0}.get(value.upper(), value)
        if re.search(r"\bPRIMARY\s+KEY\b", rest, re.I):
            key.append(c[1])
        columns.append((c[1], c[2], options))
    if not key:
        raise ValueError("a table needs a primary key")
    options = dict(tuple(x.strip() for x in o.split("=", 1)) for o in (m[3] or "").split(",") if "=" in o)
    return Table(m[1], columns, key, options)


def default_literal(value: object) -> str:
    """A default as SQL text: numbers as they are, truth as 1 or 0, else quoted."""
    if isinstance(value, bool):
        return "1" if value else "0"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


class Catalog:
    """Tables of a session, and system tables that list them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}

    def create(self, sql: str) -> Table:
        made = parse_create_table(sql)
        if made.name in self.tables:
            if re.search(r"IF\s+NOT\s+EXISTS", sql, re.I):
                return self.tables[made.name]
            raise ValueError(f"table {made.name} exists")
        self.tables[made.name] = made
        self.spark.createDataFrame([], made.schema).createOrReplaceTempView(made.name)
        return made

    def drop(self, name: str) -> None:
        del self.tables[name]
        self.spark.catalog.dropTempView(name)

    def with_defaults(self, name: str, rows: DataFrame) -> DataFrame:
        """rows with the table's columns, absent ones at their defaults."""
        schema = self.tables[name].schema
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(f.metadata.get("default")).cast(f.dataType).alias(f.name) for f in schema))

    def system_tables(self) -> dict[str, DataFrame]:
        """tables and columns as DataFrames."""
        tables = [(t.name, ",".join(t.key), len(t.columns)) for t in self.tables.values()]
        columns = [(t.name, n, storage_class(kind), n in t.key) for t in self.tables.values() for n, kind, _ in t.columns]
        return {
            "tables": self.spark.createDataFrame(tables, "table_name string, primary_key string, n_columns int"),
            "columns": self.spark.createDataFrame(columns, "table_name string, column_name string, storage_class string, in_key boolean"),
        }


class KeyedReads:
    """get, find, filter, get_all, has and count over a small table; pass a cached one to read it often."""

    def __init__(self, df: DataFrame, key: str):
        self.df, self.key = df, key

    def get(self, value: object) -> Row | None:
        return self.df.where(F.col(self.key) == F.lit(value)).first()

    def find(self, predicate: Column) -> Row | None:
        return self.df.where(predicate).first()

    def filter(self, predicate: Column | Callable[[DataFrame], Column]) -> DataFrame:
        return self.df.where(predicate(self.df) if callable(predicate) and not isinstance(predicate, Column) else predicate)

    def get_all(self) -> DataFrame:
        return self.df

    def has(self, value: object) -> bool:
        return self.get(value) is not None

    def count(self) -> int:
        return self.df.count()
