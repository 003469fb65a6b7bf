"""Query registry: a Spark query and, where SQL can say it, its independent oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def with_ctes(body: str, *ctes: str, recursive: bool = False) -> str:
    """SQL text with common table expressions in front."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()
