"""Registry of named queries: each is a function (spark, sf_dir) -> DataFrame, with SQL beside it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries are named {name}")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def registered() -> dict[str, Query]:
    from . import catalogue  # noqa: F401  fills the registry

    return _queries


def registered_sql() -> dict[str, str]:
    registered()
    return _sql
