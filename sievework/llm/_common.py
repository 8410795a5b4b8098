"""Shared plumbing of the training-data operators: reading, checkpoints, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkpoint import Scratch, cut, shared_folder

__all__ = ["Scratch", "blank_to_null", "checked_broadcast", "cut", "let", "query_reading", "read", "shared_folder"]
#: A side is broadcast only when its counted rows do not exceed this bound.
BROADCAST_ROWS = 20_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the data set in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its rows were counted and are few; else unchanged.

    Past the bound the join is left to a shuffle, which has no size limit. ``df`` should be
    cheap to count (a checkpoint or a small table).
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def blank_to_null(c: Column) -> Column:
    """The trimmed text, or null where it is empty."""
    return F.nullif(F.trim(c), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def query_reading(*names: str) -> Callable:
    """Decorator: ``f(tables...)`` becomes ``f(spark, sf_dir)`` reading the named tables."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(read(spark, sf_dir, n) for n in names))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return run

    return wrap
