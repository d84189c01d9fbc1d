"""Statements that search a log table, once or as a live query."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

#: Rows that a search shows.
LIMIT = 200
_UNITS = {"ms": "milliseconds", "s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def since(text: str, now: datetime) -> datetime:
    """The time that "-15m" and its like (ms, s, m, h, d) mean, or that an ISO text gives."""
    if m := re.fullmatch(r"-(\d+)(ms|[smhd])", text.strip(), re.I):
        return now - timedelta(**{_UNITS[m[2].lower()]: int(m[1])})
    try:
        return datetime.fromisoformat(text.strip())
    except ValueError as e:
        raise ValueError(f"{text!r} is no time and no span such as -15m") from e


@dataclass(frozen=True)
class LogSearch:
    """Filters, all optional: equal columns, an inclusive range of time, and text that the message holds.

    newest names the columns that rows are ordered by, all descending; the
    first of them is the time.
    """

    table: str = "logs"
    equal: tuple[tuple[str, object], ...] = ()
    start: datetime | None = None
    end: datetime | None = None
    contains: str | None = None
    message: str = "message"
    newest: tuple[str, ...] = ("timestamp", "created_at", "log_id")
    columns: str = "*"

    def _filters(self) -> list[tuple[str, str, object]]:
        time = self.newest[0]
        found = [(column, "=", value) for column, value in self.equal if value is not None]
        found += [(time, op, at.isoformat(" ")) for op, at in ((">=", self.start), ("<=", self.end)) if at is not None]
        return found + ([(self.message, "LIKE", f"%{self.contains}%")] if self.contains else [])

    def _text(self, marks: list[str]) -> str:
        tests = [f"{c} {op} {mark}" for (c, op, _), mark in zip(self._filters(), marks, strict=True)]
        where = f" WHERE {' AND '.join(tests)}" if tests else ""
        return f"SELECT {self.columns} FROM {self.table}{where} ORDER BY {', '.join(f'{c} DESC' for c in self.newest)} LIMIT {LIMIT}"

    def statement(self) -> tuple[str, list]:
        """The text with numbered markers, and their values."""
        values = [v for *_, v in self._filters()]
        return self._text([f"?{i}" for i in range(1, len(values) + 1)]), values

    def live(self) -> str:
        """The live twin: values stand in the text, quoted."""
        quoted = [str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'" for *_, v in self._filters()]
        return "LIVE " + self._text(quoted)
