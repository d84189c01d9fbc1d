"""Whether a nested statement reads a bounded number of rows, judged by its text alone."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Most placeholders of a bounded IN list.
MAX_IN_PARAMS = 100


class Verdict(NamedTuple):
    classification: str
    reason: str


def classify(sql: str) -> Verdict:
    """BOUNDED or UNBOUNDED and why; joins, subqueries and scans are never bounded."""
    text = (sql or "").strip()
    if not text:
        raise ValueError("a statement is needed")

    def has(pattern: str) -> bool:
        return re.search(pattern, text, re.I | re.S) is not None

    if has(r"\bjoin\b"):
        return Verdict("UNBOUNDED", "join")
    if has(r"\(\s*select\b"):
        return Verdict("UNBOUNDED", "subquery")
    if not has(r"\bwhere\b"):
        return Verdict("UNBOUNDED", "full scan")
    in_list = re.search(r"\bin\s*\(([^)]*)\)", text, re.I)
    open_list = has(r"\bin\s*\(") and in_list is None
    by_list = has(r"\bin\s*\(") or has(r"\bany\s*\(")
    if by_list and not open_list and (in_list[1].count("?") if in_list else 1) <= MAX_IN_PARAMS:
        return Verdict("BOUNDED", "bounded list")
    limited, ranged = has(r"\blimit\b"), has(r"[<>]|\bbetween\b")
    if ranged and not limited:
        return Verdict("UNBOUNDED", "range without limit")
    if not ranged and not by_list:
        return Verdict("BOUNDED", "point lookup")
    return Verdict("BOUNDED", "limited") if limited else Verdict("UNBOUNDED", "unknown shape")
