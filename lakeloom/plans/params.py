"""Positional parameters: ?, $N and ?N of one statement become Spark's positional markers."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|\$\d+|\?\d*", re.S)


def bind(sql: str, params: list) -> tuple[str, list]:
    """(statement with bare ? markers, values in their order).

    Numbered markers may come in any order and repeat; every number from 1 to
    the greatest must occur and have a value. Plain and numbered markers don't
    mix. Markers inside quotes and comments are text.
    """
    numbers: list[int] = []
    plain = 0

    def swap(m: re.Match) -> str:
        nonlocal plain
        token = m[0]
        if token == "?":
            plain += 1
            return "?"
        if token[0] in "$?":
            numbers.append(int(token[1:]))
            return "?"
        return token

    out = _TOKEN.sub(swap, sql)
    if plain and numbers:
        raise ValueError("plain and numbered parameters can't be mixed")
    if plain:
        if plain != len(params):
            raise ValueError(f"{plain} parameters in the statement, {len(params)} values")
        return out, list(params)
    if numbers:
        if min(numbers) < 1 or max(numbers) > len(params):
            raise ValueError(f"parameter out of range: {len(params)} values")
        if missing := set(range(1, max(numbers) + 1)) - set(numbers):
            raise ValueError(f"parameters {sorted(missing)} are skipped")
    elif params:
        raise ValueError("values for a statement without parameters")
    return out, [params[n - 1] for n in numbers]
