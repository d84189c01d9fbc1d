"""What a plan does, and advice on layout, read from Spark's own plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .classifier import classify


def plan_text(df: DataFrame) -> str:
    """The formatted physical plan."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def summary(df: DataFrame) -> dict:
    """Joins, exchanges, pushed filters, read columns and Python steps of a plan."""
    text = plan_text(df)
    head = text.split("\n\n\n")[0]
    return {
        "joins": re.findall(r"(\w*(?:Join|CartesianProduct))\b", head),
        "exchanges": len(re.findall(r"\bExchange\b", head)),
        "broadcasts": len(re.findall(r"\bBroadcastExchange\b", head)),
        "python": re.findall(r"\w*(?:Python|Pandas|Arrow)\w*", head),
        "pushed": re.findall(r"PushedFilters: \[(.*?)\]\n", text),
        "read": re.findall(r"ReadSchema: struct<(.*?)>\n", text),
    }


def advise(sql: str, indexes: dict[str, list[list[str]]] | None = None) -> dict:
    """Usable key orders and suggestions for a statement over one or more tables.

    indexes: table → key orders (column lists) that exist. An order serves a
    WHERE column if that leads it. Suggestions (sort or bucket columns) skip
    what exists already.
    """
    tables = re.findall(r"\b(?:FROM|JOIN)\s+(\w+)(?:\s+(?:AS\s+)?(?!ON\b|WHERE\b|JOIN\b|LEFT\b|INNER\b|ORDER\b|GROUP\b|LIMIT\b)(\w+))?", sql, re.I)
    names = {alias or t: t for t, alias in tables} | {t: t for t, _ in tables}
    default = tables[0][0] if tables else None
    have, wanted = indexes or {}, []

    def note(ref: str, use: str) -> None:
        table, _, column = ref.rpartition(".")
        target = names.get(table, default) if table else default
        if target and (target, column, use) not in wanted:
            wanted.append((target, column, use))

    if m := re.search(r"\bWHERE\b(.*?)(?:\bGROUP\b|\bORDER\b|\bLIMIT\b|$)", sql, re.I | re.S):
        for ref in re.findall(r"([\w.]+)\s*(?:=|<|>|\bIN\b|\bBETWEEN\b|\bLIKE\b)", m[1], re.I):
            if not ref[0].isdigit():
                note(ref, "filter")
    if m := re.search(r"\bORDER\s+BY\b(.*?)(?:\bLIMIT\b|$)", sql, re.I | re.S):
        for ref in m[1].split(","):
            note(ref.split()[0], "sort")
    for a, b in re.findall(r"\bON\s+([\w.]+)\s*=\s*([\w.]+)", sql, re.I):
        note(a, "join")
        note(b, "join")
    usable = [{"table": t, "columns": cols, "use": use} for t, c, use in wanted for cols in have.get(t, []) if cols and cols[0] == c]
    served = {(u["table"], u["columns"][0]) for u in usable}
    return {
        "access": "index_scan" if any(u["use"] == "filter" for u in usable) else "full_scan",
        "usable": usable,
        "suggestions": [{"table": t, "columns": [c], "use": use} for t, c, use in wanted if (t, c) not in served],
    }


def call_report(statements: list[str]) -> dict:
    """How many statements may be nested calls, how many are rejected, and which."""
    rejected = [s for s in statements if classify(s).classification != "BOUNDED"]
    return {"bounded": len(statements) - len(rejected), "rejected": len(rejected), "statements": rejected}
