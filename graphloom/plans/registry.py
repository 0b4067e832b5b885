"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a plan under its function's name; ``sql`` is its oracle."""

    def add(plan: Query) -> Query:
        name = plan.__name__
        if name in _queries:
            raise ValueError(f"two plans are named {name}")
        _queries[name] = plan
        if sql:
            _oracles[name] = sql
        return plan

    return add


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)


def _load() -> None:
    from . import curation, graphs, relational, scoring  # noqa: F401
