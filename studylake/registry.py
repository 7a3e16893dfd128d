"""All queries by name. A query takes (spark, folder of tables) and returns a DataFrame; most have SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

#: Modules that register queries when they are imported.
MODULES = ("learning", "relational", "retrieval", "texts", "study", "planning", "ranking", "layouts", "structures", "papers", "composed", "archives", "upkeep")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows if there is one."""

    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"studylake.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return _queries


def oracle_sql() -> dict[str, str]:
    _load()
    return _sql
