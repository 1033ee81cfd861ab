"""Registry of the queries that run every operator on the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FAMILIES = ["mining", "merging", "auditing", "enriching", "referencing", "cleaning", "authoring", "ledgers", "io"]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its check."""
    def add(fn: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} registered twice")
        _queries[name] = fn
        if sql is not None:
            _sql[name] = sql
        return fn
    return add


def _load() -> None:
    for family in FAMILIES:
        import_module(f"quire.plans.catalog.{family}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
