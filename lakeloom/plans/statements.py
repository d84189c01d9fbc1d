"""Statements that change a table, as text: INSERT, UPDATE, DELETE, ALTER TABLE and index statements.

A statement gives the table's rows after it, and those it returns; publishing
them is the caller's (operators.dml.Snapshots). Expressions are the dialect's.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compat import spark_type
from ..operators import dml
from .dialect import outside_literals, query, register_functions, split_list, translate
from .params import bind


class Change(NamedTuple):
    """The changed table's name, its rows after the statement, and the rows touched (or those named by RETURNING)."""

    table: str
    rows: DataFrame
    touched: DataFrame


def literal(value: object) -> str:
    """A value as dialect text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return repr(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def _with_values(sql: str, params: list) -> str:
    """The statement with literals for its parameters."""
    text, values = bind(sql, params)
    left = iter(values)
    return outside_literals(text, lambda t: re.sub(r"\?", lambda _: literal(next(left)), t))


def _clause(sql: str, word: str) -> tuple[str, str | None]:
    """(what stands before the last such word outside brackets and text, what stands behind it or None)."""
    plain = outside_literals(sql, lambda t: t, lambda p: "." * len(p))
    depth, at = 0, None
    for m in re.finditer(rf"[()]|\b{word}\b", plain, re.I):
        depth += (m[0] == "(") - (m[0] == ")")
        if m[0] not in "()" and not depth:
            at = m
    return (sql, None) if at is None else (sql[: at.start()], sql[at.end() :].strip())


def _name(text: str) -> str:
    return text.strip().strip('"`')


def _where(text: str | None) -> Column:
    return F.lit(True) if text is None else F.expr(translate(text))


def _returned(touched: DataFrame, text: str | None) -> DataFrame:
    return touched if text is None else dml.returning(touched, *(_name(c) for c in split_list(text)))


def _incoming(spark: SparkSession, target: DataFrame, columns: list[str], source: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The rows that an INSERT brings, in the target's types."""
    text = source if re.match(r"\s*(SELECT|WITH)\b", source, re.I) else f"SELECT * FROM {source.strip()} AS v"
    rows = query(spark, text, **tables)
    if len(rows.columns) != len(columns):
        raise ValueError(f"{len(columns)} columns and {len(rows.columns)} values")
    kinds = dict(target.dtypes)
    return rows.toDF(*columns).select(*(F.col(c).cast(kinds[c]).alias(c) for c in columns))


def _insert(spark: SparkSession, sql: str, tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> Change:
    body, returning = _clause(sql, "RETURNING")
    body, conflict = _clause(body, r"ON\s+CONFLICT")
    m = re.fullmatch(r"\s*INSERT\s+(?:OR\s+(IGNORE|REPLACE)\s+)?INTO\s+(\S+?)\s*(?:\(([^()]*)\))?\s*((?:VALUES|SELECT|WITH)\b.*)", body, re.I | re.S)
    if not m:
        raise ValueError("can't read the INSERT")
    name, how = _name(m[2]), (m[1] or "").upper()
    if conflict is not None:
        action = re.fullmatch(r"(?:\(([^()]*)\)\s*)?DO\s+(NOTHING|UPDATE\b.*)", conflict, re.I | re.S)
        if not action:
            raise ValueError("can't read ON CONFLICT")
        # As documented, DO UPDATE replaces the whole row.
        how = "IGNORE" if action[2].upper() == "NOTHING" else "REPLACE"
    target = tables[name]
    columns = [_name(c) for c in m[3].split(",")] if m[3] else target.columns
    if unknown := set(columns) - set(target.columns):
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    new = _incoming(spark, target, columns, m[4], tables)
    new = new.select(*(F.col(c) if c in columns else F.lit(None).cast(k).alias(c) for c, k in target.dtypes))
    key = keys.get(name, [])
    if how and not key:
        raise ValueError(f"table {name} has no key")
    if how == "IGNORE":
        new = dml.one_per_key(new, key).join(target.select(*key), key, "left_anti").select(*target.columns)
    elif how == "REPLACE":
        new = dml.one_per_key(new, key)
        target = target.join(new.select(*key), key, "left_anti").select(*target.columns)
    return Change(name, dml.insert(target, new), _returned(new, returning))


def _update(spark: SparkSession, sql: str, tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> Change:
    body, returning = _clause(sql, "RETURNING")
    body, where = _clause(body, "WHERE")
    m = re.fullmatch(r"\s*UPDATE\s+(\S+)\s+SET\s+(.*)", body, re.I | re.S)
    if not m:
        raise ValueError("can't read the UPDATE")
    name = _name(m[1])
    changes = {}
    for part in split_list(m[2]):
        column, _, value = part.partition("=")
        changes[_name(column)] = F.expr(translate(value.strip()))
    hit = _where(where)
    return Change(name, dml.update(tables[name], changes, hit, keys.get(name, [])), _returned(dml.update(tables[name].where(hit), changes, F.lit(True), keys.get(name, [])), returning))


def _delete(spark: SparkSession, sql: str, tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> Change:
    body, returning = _clause(sql, "RETURNING")
    body, where = _clause(body, "WHERE")
    m = re.fullmatch(r"\s*DELETE\s+FROM\s+(\S+)\s*", body, re.I)
    if not m:
        raise ValueError("can't read the DELETE")
    name = _name(m[1])
    return Change(name, dml.delete(tables[name], _where(where)), _returned(tables[name].where(_where(where)), returning))


def _alter(spark: SparkSession, sql: str, tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> Change:
    m = re.fullmatch(r"\s*ALTER\s+TABLE\s+(\S+)\s+(.*)", sql, re.I | re.S)
    name, step = _name(m[1]), m[2].strip()
    df, key = tables[name], keys.get(name, [])
    if a := re.fullmatch(r"ADD\s+(?:COLUMN\s+)?(\S+)\s+([\w ]+?(?:\s*\([^)]*\))?)(?:\s+DEFAULT\s+(.*))?", step, re.I | re.S):
        out = dml.add_column(df, _name(a[1]), spark_type(a[2]), None)
        out = out.withColumn(_name(a[1]), F.expr(translate(a[3])).cast(spark_type(a[2]))) if a[3] else out
    elif a := re.fullmatch(r"DROP\s+(?:COLUMN\s+)?(\S+)", step, re.I):
        out = dml.drop_column(df, _name(a[1]), key)
    elif a := re.fullmatch(r"RENAME\s+(?:COLUMN\s+)?(\S+)\s+TO\s+(\S+)", step, re.I):
        out = dml.rename_column(df, _name(a[1]), _name(a[2]))
    elif a := re.fullmatch(r"ALTER\s+(?:COLUMN\s+)?(\S+)\s+(?:SET\s+DATA\s+)?TYPE\s+(.*)", step, re.I | re.S):
        out = dml.alter_type(df, _name(a[1]), spark_type(a[2]))
    else:
        raise ValueError("can't read the ALTER TABLE")
    return Change(name, out, df.limit(0))


def _index(spark: SparkSession, sql: str, tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> Change:
    """Files have no indexes; the statement is read, checked and changes nothing."""
    m = re.fullmatch(r"\s*CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?\S+\s+ON\s+(\S+?)\s*\(([^()]*)\)\s*", sql, re.I)
    if not m:
        raise ValueError("can't read the CREATE INDEX")
    name = _name(m[1])
    if unknown := {_name(c.split()[0]) for c in m[2].split(",")} - set(tables[name].columns):
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    return Change(name, tables[name], tables[name].limit(0))


_KINDS = {"INSERT": _insert, "UPDATE": _update, "DELETE": _delete, "ALTER": _alter, "CREATE": _index}


def change(spark: SparkSession, sql: str, params: list | None = None, keys: dict[str, list[str]] | None = None, **tables: DataFrame) -> Change:
    """Run one statement over the named tables, whose keys are named by table."""
    register_functions(spark)
    text = _with_values(sql, params or []).strip().rstrip(";").strip()
    kind = text.split(None, 1)[0].upper() if text else ""
    if kind not in _KINDS:
        raise ValueError(f"not a statement that changes a table: {kind}")
    return _KINDS[kind](spark, text, tables, keys or {})
