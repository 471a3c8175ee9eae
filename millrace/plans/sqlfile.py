"""Named queries in SQL files: ``-- name: x`` begins one, the next semicolon outside quotes and comments ends it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MARK = re.compile(r"^--\s*name:\s*(\S+)\s*$", re.MULTILINE)
PIECE = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|;", re.DOTALL)


def parse_queries(text: str) -> list[tuple[str, str]]:
    """(name, query) in their order."""
    out = []
    for m in MARK.finditer(text):
        rest = text[m.end() :]
        end = next((p.start() for p in PIECE.finditer(rest) if p[0] == ";"), None)
        if end is not None:
            out.append((m[1], rest[:end].strip()))
    return out


def run_queries(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """Each query over the registered views, lazily."""
    return {name: spark.sql(query) for name, query in parse_queries(text)}
