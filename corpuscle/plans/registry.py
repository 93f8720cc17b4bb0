"""Registered queries: each over whole tables, with SQL of the same meaning where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import connector_queries, index_queries, knowledge_queries, report_queries, retrieval_queries, stream_queries, text_queries  # noqa: F401  they register themselves

    return dict(QUERIES), dict(ORACLES)
