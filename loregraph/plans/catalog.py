"""Where queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name (without an underscore at the end), with its SQL."""

    def add(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add
