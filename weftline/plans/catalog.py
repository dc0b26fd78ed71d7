"""All queries of the core, by name, with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL of the same result if there is any."""

    def register(function: Query) -> Query:
        name = function.__name__
        assert name not in _QUERIES, name
        _QUERIES[name] = function
        if sql:
            _SQL[name] = sql
        return function

    return register


def _load() -> None:
    from weftline.plans import curation, evaluation, flows, packs, pairs, relational, small, storage  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
