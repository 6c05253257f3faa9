"""Registry of named queries over the bound tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
GROUP: dict[str, str] = {}
MODULES = ["pairs", "filters", "joins", "dedup", "aggregates", "evaluation", "series", "vectors", "texts", "ranking", "quality", "plans", "feeds", "sources"]


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL statement."""

    def wrap(fn):
        from seguelake.bindings import Tables
        from seguelake.session import split_long_code

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            split_long_code(spark)
            return fn(Tables(spark, folder))

        QUERIES[name] = run
        GROUP[name] = fn.__module__.rsplit(".", 1)[-1]
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"seguelake.queries.{module}")
