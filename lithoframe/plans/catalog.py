"""Registered queries of the engine's own operators, with their DuckDB statements.

Modules register their queries with `query`; importing this module imports them
all.  A statement may be left out where SQL cannot express the operator.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

FLAGSHIP = "hybrid_search"

_MODULES = ("retrieval", "relational", "text_columns", "near_copies", "fact_graph", "decisions", "statistics", "incremental", "links", "upkeep", "questions", "vectors", "names")


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def register(run):
        if run.__name__ in _QUERIES:
            raise ValueError(f"two queries named {run.__name__}")
        _QUERIES[run.__name__] = (run, sql)
        return run

    return register


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"lithoframe.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
