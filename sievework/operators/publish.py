"""Sinks: page and bucket files, self-check, delivery in messages, run metrics."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .state import replace_table


def self_check(df: DataFrame, keep: Iterable[str], bad) -> None:
    """Refuse publication: a column outside the whitelist, or any row for which ``bad`` holds."""
    extra = set(df.columns) - set(keep)
    if extra:
        raise AssertionError(f"columns outside the whitelist: {sorted(extra)}")
    if not df.filter(bad).limit(1).isEmpty():
        raise AssertionError("a row fails the publication check")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, replacing the folder only when all is written."""
    replace_table(df, path, "json")


def write_buckets(finished: DataFrame, folder: str) -> None:
    """Every bucket's kept rows (with their ``bucket``) and its counters, each replaced as a whole."""
    replace_table(finished.filter("fate = 'kept'"), f"{folder}/rows", "json")
    replace_table(finished.groupBy("bucket", "fate", "reason").agg(F.count("*").alias("n")).coalesce(1), f"{folder}/counts", "json")


def overflowing(finished: DataFrame, first: str = "junior_title") -> DataFrame:
    """``bucket, n``: buckets whose cap cut off rows of the first priority."""
    return finished.filter((F.col("fate") == "cap") & F.col(first)).groupBy("bucket").agg(F.count("*").alias("n"))


def render_page(df: DataFrame, template: str, slots: dict[str, str], limit: int = 2_000) -> str:
    """``template`` with ``{{name}}`` slots filled, the rows last; ``</`` is escaped inside the data.

    A page is of bounded size: more than ``limit`` rows are refused, not cut.
    """
    rows = [r.asDict(True) for r in df.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"a page holds at most {limit} rows; cap them first")
    for k, v in sorted(slots.items(), key=lambda x: len(x[1])):
        if template.count("{{" + k + "}}") != 1:
            raise AssertionError(f"slot {k} must occur once")
        template = template.replace("{{" + k + "}}", v)
    blob = json.dumps(rows, ensure_ascii=False, default=str).replace("</", "<\\/")
    if template.count("{{data}}") != 1:
        raise AssertionError("slot data must occur once")
    return template.replace("{{data}}", blob)


def deliver(batches: DataFrame, line, send: Callable[[str], bool | None], order: str = "rn") -> DataFrame:
    """Send each message; ``sent`` is true, false (try again) or null (rejected for good).

    Messages are few by their batch limit and go out from the driver, in order, stopping at the
    first that must be tried again.
    """
    spark = batches.sparkSession
    texts = batches.select("message", order, line.alias("line")).groupBy("message").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("t")).orderBy("message").collect()
    out, stopped = [], False
    for r in texts:
        ok = False if stopped else send(r.t)
        stopped |= ok is False
        out.append((r.message, ok))
    return batches.join(spark.createDataFrame(out, "message int, sent boolean"), "message", "left")


def observed(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    """``df`` with metrics that fill in when it runs (row counts of stages without another pass)."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), *(e.alias(k) for k, e in metrics.items())), o
