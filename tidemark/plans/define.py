"""Where queries and their SQL twins register."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def split(columns: str) -> list[str]:
    """A select list cut at its top-level commas."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[at:i].strip())
            at = i + 1
    return [*out, columns[at:].strip()]
