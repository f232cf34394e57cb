"""The queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None):
    """Registers a function of the tables' DataFrames; sql None: tests hold it against a plain definition."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])
        if sql is not None:
            SQL[name] = sql
        return f

    return register
