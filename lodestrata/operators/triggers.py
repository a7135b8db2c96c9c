"""Trigger match expressions compiled to predicates: =, >, startsWith, contains, endsWith, AND, OR, parentheses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\()|(\))|'((?:[^']|'')*)'|(-?\d+(?:\.\d+)?)|(=|>)|([A-Za-z_][\w.]*))")


def compile_match(text: str) -> Column:
    """A Column for the expression; malformed text raises ValueError."""
    found, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r}")
        at = m.end()
        kind = next(i for i in range(1, 7) if m[i] is not None)
        found.append((kind, m[kind].replace("''", "'") if kind == 3 else m[kind]))
    place = 0

    def peek() -> tuple[int, str]:
        return found[place] if place < len(found) else (0, "")

    def take() -> tuple[int, str]:
        nonlocal place
        place += 1
        return found[place - 1] if place <= len(found) else (0, "")

    def either() -> Column:
        left = both()
        while peek()[0] == 6 and peek()[1].upper() == "OR":
            take()
            left = left | both()
        return left

    def both() -> Column:
        left = test()
        while peek()[0] == 6 and peek()[1].upper() == "AND":
            take()
            left = left & test()
        return left

    def test() -> Column:
        kind, name = take()
        if kind == 1:
            inner = either()
            if take()[0] != 2:
                raise ValueError("missing )")
            return inner
        if kind != 6:
            raise ValueError(f"a field is expected, not {name!r}")
        op_kind, op = take()
        value_kind, value = take()
        if value_kind not in (3, 4):
            raise ValueError("a value is expected")
        literal = F.lit(value) if value_kind == 3 else F.lit(float(value))
        ops = {"=": lambda c: c == literal, ">": lambda c: c > literal, "startswith": lambda c: c.startswith(literal), "endswith": lambda c: c.endswith(literal), "contains": lambda c: c.contains(literal)}
        if op_kind not in (5, 6) or op.lower() not in ops:
            raise ValueError(f"unknown operator {op!r}")
        return ops[op.lower()](F.col(name))

    out = either()
    if place != len(found):
        raise ValueError("unexpected text at the end")
    return out
