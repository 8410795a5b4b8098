"""A registry of queries over named tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Queries by name, and the SQL of those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, *tables: str, sql: str | None = None):
        """Register ``f(tables...)`` under its name; it is read from ``<dir>/<table>.parquet``."""

        def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            self.queries[f.__name__] = run
            if sql:
                self.sql[f.__name__] = sql
            return f

        return wrap
