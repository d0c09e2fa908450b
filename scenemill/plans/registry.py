"""Collects the named queries and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scenemill.sources.readers import read_parquet

MODULES = ("series_queries", "metric_queries", "world_queries", "text_queries", "more_queries", "drive_queries")

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a (spark, sf_dir) query, with the SQL that gives the same rows where there is one."""

    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; NaN reads as null."""
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every query module and return what they registered."""
    for module in MODULES:
        importlib.import_module(f"scenemill.plans.{module}")
    return dict(_QUERIES), dict(_SQL)
