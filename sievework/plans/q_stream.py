"""Queries on the streaming fronts (extensions) and on the feed adapters' registry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import fronts as ST


def stream_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key of the event stream once."""
    out = ST.stream_admitted(ST.events_stream(spark, sf_dir), ["user_id", "event_type"], horizon="60 days")
    return ST.run_to_table(spark, out.select("user_id", "event_type"), f"seen_{uuid.uuid4().hex}")


def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each kind by day."""
    out = ST.run_to_table(spark, ST.stream_health(ST.events_stream(spark, sf_dir)), f"health_{uuid.uuid4().hex}", "complete")
    return out.select(F.to_date("w.start").alias("day"), "event_type", "n")


QUERIES = {"stream_seen": stream_seen, "stream_health": stream_health}
SQL = {"stream_seen": "SELECT DISTINCT user_id, event_type FROM events", "stream_health": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"}
