"""The SQL front-end: parameters, dialect functions and the LIVE and CALL BINDING prefixes, before Spark's parser."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.compat import EXTRACT_PARTS, TRUNC_PARTS
from .params import bind

#: What is text: literals, quoted names, comments.
_LITERAL = re.compile(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/)", re.S)
#: Types whose quotients are cut to whole numbers.
_WHOLE = "('tinyint', 'smallint', 'int', 'bigint')"
#: Stands for a division that has been seen to.
_DIVIDED = "\x01"
#: Words before a bracket that aren't a function's name.
_NO_FUNCTION = ("SELECT", "DISTINCT", "WHERE", "AND", "OR", "ON", "BY", "IN", "THEN", "ELSE", "WHEN", "NOT", "CASE", "HAVING", "AS", "BETWEEN")
#: Aggregates whose unaliased call is a column's name.
_AGGREGATES = ("count", "sum", "avg", "min", "max")
_COMMANDS = {"SELECT": "SELECT {n}", "WITH": "SELECT {n}", "INSERT": "INSERT 0 {n}", "UPDATE": "UPDATE {n}", "DELETE": "DELETE {n}"}


def outside_literals(sql: str, change, quoted=lambda part: part) -> str:
    """sql with change applied between literals, quoted names and comments, and quoted to those."""
    return "".join(quoted(part) if i % 2 else change(part) for i, part in enumerate(_LITERAL.split(sql)))


def _spark_quoted(part: str) -> str:
    """A literal, which Spark reads with backslashes, or a quoted name, in Spark's quotes."""
    if part[0] == '"':
        return "`" + part[1:-1].replace('""', '"').replace("`", "``") + "`"
    return "'" + part[1:-1].replace("\\", "\\\\").replace("''", "\\'") + "'" if part[0] == "'" else part


def _hidden(sql: str) -> str:
    """sql with text blanked out, place for place."""
    return outside_literals(sql, lambda t: t, lambda part: "." * len(part))


def _close(sql: str, at: int) -> int:
    """The place behind the bracket that closes the one at at."""
    depth = 0
    for k in range(at, len(sql)):
        depth += (sql[k] == "(") - (sql[k] == ")")
        if not depth:
            return k + 1
    raise ValueError("a bracket isn't closed")


def split_list(sql: str, mark: str = ",") -> list[str]:
    """The parts between marks that stand outside brackets and text."""
    plain, parts, start, depth = _hidden(sql), [], 0, 0
    for k, c in enumerate(plain):
        depth += (c == "(") - (c == ")")
        if c == mark and not depth:
            parts.append(sql[start:k])
            start = k + 1
    return [*parts, sql[start:]]


def name_aggregates(sql: str) -> str:
    """Unaliased aggregates of the outermost SELECT, named as they are written but for spaces: COUNT(*), SUM(a)."""
    plain = _hidden(sql)
    m = re.match(r"\s*SELECT\s+(?:DISTINCT\s+)?", plain, re.I)
    if not m:
        return sql
    end, depth = len(plain), 0
    for w in re.finditer(r"[()]|\bFROM\b", plain[m.end() :], re.I):
        depth += (w[0] == "(") - (w[0] == ")")
        if not depth and w[0].upper() == "FROM":
            end = m.end() + w.start()
            break
    items = []
    for item in split_list(sql[m.end() : end]):
        text = item.strip()
        if re.match(rf"(?:{'|'.join(_AGGREGATES)})\s*\(", text, re.I) and _close(_hidden(text), text.index("(")) == len(text):
            name = re.sub(r"\s*([(),])\s*", r"\1", text)
            item = f"{item.rstrip()} AS `{re.sub(r'^[a-z]+', lambda w: w[0].upper(), name, flags=re.I).replace('`', '``')}` "
        items.append(item)
    return sql[: m.end()] + ",".join(items) + sql[end:]


def divide_integers(sql: str) -> str:
    """Quotients of whole numbers cut towards zero, as doubles (operands' types are known only later); null over zero."""
    operand = r"(?:\d+(?:\.\d+)?|[A-Za-z_`][\w.`]*)"
    while True:
        plain = _hidden(sql)
        at = plain.find("/")
        if at < 0:
            return sql.replace(_DIVIDED, "/")
        left, right = at - 1, at + 1
        while left >= 0 and plain[left].isspace():
            left -= 1
        if left >= 0 and plain[left] == ")":
            depth, k = 0, left
            while k >= 0:
                depth += (plain[k] == ")") - (plain[k] == "(")
                if not depth:
                    break
                k -= 1
            head = re.search(r"[A-Za-z_]\w*\s*$", plain[:k])
            begin = head.start() if head and head[0].strip().upper() not in _NO_FUNCTION else k
        else:
            m = re.search(r"(?::p)?[\w.`]+$", sql[: left + 1])
            if not m:
                raise ValueError("nothing stands before /")
            begin = m.start()
        m = re.compile(rf"\s*(?P<head>[A-Za-z_]\w*\s*)?(?=\()|\s*-?\s*{operand}|\s*:p\d+").match(sql, right)
        if not m:
            raise ValueError("nothing stands behind /")
        end = _close(plain, m.end()) if m.end() < len(sql) and plain[m.end()] == "(" else m.end()
        a, b = sql[begin : left + 1], sql[right:end].strip()
        whole = f"typeof({a}) IN {_WHOLE} AND typeof({b}) IN {_WHOLE}"
        cut = f"CASE WHEN {whole} THEN CAST({a} AS BIGINT) div nullif(CAST({b} AS BIGINT), 0) ELSE {a} {_DIVIDED} nullif({b}, 0) END"
        sql = f"{sql[:begin]}({cut}){sql[end:]}"


def translate(sql: str) -> str:
    """Dialect functions as Spark expressions; text in quotes stays."""

    def extracted(m: re.Match) -> str:
        part = m[1].lower()
        if part not in EXTRACT_PARTS:
            raise ValueError(f"no field {m[1]} to extract")
        # The argument may hold parentheses, so only the head is rewritten.
        return {"dow": "dow_of(", "epoch": "epoch_of("}.get(part, f"{ {'doy': 'dayofyear', 'day': 'dayofmonth'}.get(part, part) }(")

    def change(text: str) -> str:
        text = re.sub(r"\bextract\s*\(\s*(\w+)\s+from\b", extracted, text, flags=re.I)
        text = re.sub(r"\bdate_trunc\s*\(", "date_trunc_text(", text, flags=re.I)
        text = re.sub(r"\bnow\s*\(\s*\)|\bcurrent_timestamp\b(?:\s*\(\s*\))?", "now_text()", text, flags=re.I)
        text = re.sub(r"\bcurrent_date\b(?:\s*\(\s*\))?", "today_text()", text, flags=re.I)
        text = re.sub(r"\bcurrent_time\b(?:\s*\(\s*\))?", "time_text()", text, flags=re.I)
        return re.sub(r"\bsubstr(?:ing)?\s*\(", "substr_compat(", text, flags=re.I)

    if m := re.search(r"\bdate_trunc\s*\(\s*'(\w+)'", sql, re.I):
        if m[1].lower() not in TRUNC_PARTS:
            raise ValueError(f"no part {m[1]} to cut to")
    return outside_literals(name_aggregates(divide_integers(sql)), change, _spark_quoted)


_registered: set[str] = set()


def register_functions(spark: SparkSession) -> None:
    """SQL functions of the dialect, once a session; Catalyst inlines them."""
    session = spark._jsparkSession.sessionUUID()
    if session in _registered:
        return
    _registered.add(session)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION dow_of(at TIMESTAMP) RETURNS INT RETURN dayofweek(at) - 1")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION epoch_of(at TIMESTAMP) RETURNS BIGINT RETURN unix_timestamp(at)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION date_trunc_text(part STRING, at TIMESTAMP) RETURNS STRING RETURN date_format(date_trunc(part, at), 'yyyy-MM-dd HH:mm:ss')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION today_text() RETURNS STRING RETURN date_format(current_timestamp(), 'yyyy-MM-dd')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION time_text() RETURNS STRING RETURN date_format(current_timestamp(), 'HH:mm:ss')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION now_text() RETURNS STRING RETURN date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION substr_compat(s STRING, start INT, n INT DEFAULT 2147483647) RETURNS STRING RETURN IF(start = 0, substring(s, 1, greatest(n - 1, 0)), substring(s, start, n))")


def query(spark: SparkSession, sql: str, params: list | None = None, **tables: DataFrame) -> DataFrame:
    """Run a dialect statement over the named tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    register_functions(spark)
    text, values = bind(sql, params or [])
    # Markers that a rewriting repeats need their values again: they are numbered while it works.
    numbered = iter(range(len(values)))
    text = outside_literals(text, lambda t: re.sub(r"\?", lambda _: f":p{next(numbered)}", t))
    named = {f"p{i}": v for i, v in enumerate(values)}
    return spark.sql(translate(text), args=named) if named else spark.sql(translate(text))


def parse_live(sql: str) -> str:
    """The SELECT behind LIVE; anything else isn't a live query."""
    if not (m := re.fullmatch(r"\s*LIVE\s+(SELECT\b.*?)\s*;?\s*", sql, re.I | re.S)):
        raise ValueError("a live query is LIVE SELECT ...")
    return m[1]


def call_binding(sql: str, params: list) -> dict:
    """The request of CALL BINDING $1: one JSON object."""
    if not re.fullmatch(r"\s*CALL\s+BINDING\s+(\$1|\?)\s*;?\s*", sql, re.I) or len(params) != 1:
        raise ValueError("expected CALL BINDING with one parameter")
    request = json.loads(params[0]) if isinstance(params[0], str) else params[0]
    if not isinstance(request, dict):
        raise ValueError("the parameter of CALL BINDING is an object")
    return request


def literal_statement(sql: str) -> str:
    """A statement that may be shipped: one SELECT over one table, without parameters of its own text."""
    text = sql.strip().rstrip(";")
    if not re.match(r"SELECT\b", text, re.I) or ";" in text or re.search(r"\bJOIN\b|\bUNION\b|\(\s*SELECT\b", text, re.I):
        raise ValueError("a distributed statement is one SELECT over one table")
    return text


def command_tag(sql: str, n: int) -> str:
    """The completion tag of a statement that touched n rows."""
    word = (sql.split(None, 1) or [""])[0].upper()
    return _COMMANDS.get(word, "OK").format(n=n)


def plan_id(sql: str, params: list | None = None) -> str:
    """A name for a statement with its values: the same for the same text but for white space and letters outside quotes."""
    normal = outside_literals(sql.strip(), lambda t: re.sub(r"\s+", " ", t).lower())
    return hashlib.sha256(json.dumps([normal, params or []], default=str).encode()).hexdigest()
