"""A small registry: each query module fills its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(oracle: str | None = None, name: str | None = None):
        def add(f: Query) -> Query:
            queries[name or f.__name__] = f
            if oracle:
                sql[name or f.__name__] = oracle
            return f

        return add

    return queries, sql, query
