"""Where queries register themselves, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.sources.library import Library, check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, views: str = "", check: str | None = None):
    """Register a function of a Library as a query; ``check`` is its SQL over ``views``."""

    def register(fn: Callable[[Library], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Library(spark, folder))
        if check:
            CHECKS[name] = check_sql(views, check)
        return fn

    return register
