"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timberline.plans.tables import Tables, tables

_RUN: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in _RUN:
            raise ValueError(f"query {name} registered twice")
        _RUN[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, sf_dir: fn(tables(spark, sf_dir))

    return {name: bind(fn) for name, fn in _RUN.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from timberline.plans import (  # noqa: F401
        queries_correlate, queries_ingest, queries_parse, queries_report, queries_search, queries_stream,
    )
