"""Registry of named queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: list[str] | None = None, sql: str | None = None):
    """Register a query; ``tables`` are the domain tables its check SQL needs."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            if tables:
                prefix = cte(*tables)
                body = sql.strip()
                ORACLES[name] = f"{prefix},\n{body[4:].lstrip()}" if body[:4].upper() == "WITH" else f"{prefix}\n{body}"
            else:
                ORACLES[name] = sql.strip()
        return fn

    return add


def recursive(text: str) -> str:
    """Mark a check SQL's WITH clause as recursive."""
    return text.replace("WITH ", "WITH RECURSIVE ", 1)
