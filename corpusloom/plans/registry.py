"""Named queries over the test tables and the SQL that gives the same results."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
MODULES = ("text_queries", "record_queries", "join_queries", "analytic_queries", "term_queries", "learning_queries", "source_queries", "rule_queries")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is one."""

    def wrap(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return wrap


def _load() -> None:
    for m in MODULES:
        if importlib.util.find_spec(f"corpusloom.plans.{m}"):
            importlib.import_module(f"corpusloom.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
