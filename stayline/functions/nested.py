"""Nested text of maps, two blanks a level, scalars in single quotes: writing from paths, and reading that survives faults."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from stayline.operators.common import ship_package

_LINE = re.compile(r"^( *)('(?:[^']|'')*'|[^'\s:][^:]*):(?:\s+(.*))?$")


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def unquote(s: str) -> str:
    s = s.strip()
    return s[1:-1].replace("''", "'") if len(s) > 1 and s[0] == s[-1] == "'" else s


def emit(facts: list[tuple[list[str], str | None]]) -> str:
    """Facts (path, value) as nested text in order of first appearance; a path that is also a branch keeps its value out."""
    tree: dict = {}
    for path, value in facts:
        at = tree
        for p in path[:-1]:
            nxt = at.get(p)
            if not isinstance(nxt, dict):
                nxt = at[p] = {}
            at = nxt
        if path and not isinstance(at.get(path[-1]), dict):
            at[path[-1]] = value

    def walk(node: dict, depth: int) -> Iterator[str]:
        for k, v in node.items():
            pad = "  " * depth + quote(k) + ":"
            if isinstance(v, dict):
                yield pad
                yield from walk(v, depth + 1)
            else:
                yield pad + " " + (quote(v) if v is not None else "null")

    return "\n".join(walk(tree, 0))


def parse(text: str | None) -> list[tuple[list[str], str | None]]:
    """Leaf facts of nested text. A line that is no ``key: value`` is skipped, with what stands under it if it opens a branch."""
    out: list[tuple[list[str], str | None]] = []
    stack: list[tuple[int, str]] = []
    skip: int | None = None
    for line in (text or "").split("\n"):
        if not line.strip():
            continue
        depth = len(line) - len(line.lstrip(" "))
        if skip is not None and depth > skip:
            continue
        skip = None
        m = _LINE.match(line)
        if not m:
            skip = depth
            continue
        while stack and stack[-1][0] >= depth:
            stack.pop()
        key, value = unquote(m[2]), m[3]
        if value is None or not value.strip():
            stack.append((depth, key))
        else:
            v = value.strip()
            out.append(([k for _, k in stack] + [key], None if v == "null" else unquote(v)))
    return out


def parse_nested(text: str) -> dict:
    """The same as nested dictionaries."""
    tree: dict = {}
    for path, value in parse(text):
        at = tree
        for p in path[:-1]:
            at = at.setdefault(p, {})
        at[path[-1]] = value
    return tree


def nested_text(facts: Column) -> Column:
    """Nested text of ARRAY<STRUCT<path ARRAY<STRING>, value STRING>>; null for null. Arrow batches, one text at a time."""
    ship_package()

    @F.pandas_udf("string")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if v is None else emit([(list(x["path"]), x["value"]) for x in v]) for v in s], dtype="object")

    return f(facts)


def nested_facts(text: Column) -> Column:
    """The facts of nested text, faults skipped; empty for null or text without any."""
    ship_package()

    @F.pandas_udf("array<struct<path: array<string>, value: string>>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[{"path": p, "value": v} for p, v in parse(t)] for t in s], dtype="object")

    return f(text)
