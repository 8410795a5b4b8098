"""Structured Streaming fronts for the run-to-run state. An extension: the batch form is the norm.

``stream_admitted`` passes each key once within a horizon (state expires with the watermark);
``stream_health`` counts events of each kind in day windows; ``stream_registry`` applies the exact
batch rule to every micro-batch, as rows of one run see the registry from before the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkpoint import cut, shared_folder
from ..operators.state import read_state, register, replace_table, soft_block

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def events_stream(spark: SparkSession, sf_dir: str, schema: str = EVENTS) -> DataFrame:
    """The events table as a file stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(sf_dir)


def stream_admitted(events: DataFrame, keys: list[str], ts: str = "ts", horizon: str = "7 days") -> DataFrame:
    """The first event of each key within ``horizon``."""
    return events.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


def stream_health(events: DataFrame, kind: str = "event_type", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events of each kind by day; late events count until the watermark passes."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), kind).agg(F.count("*").alias("n"))


REGISTRY = "k string, seen string, u string, src string, city string"


def stream_registry(jobs: DataFrame, state_path: str, out_path: str, as_of: str, checkpoint: str):
    """Admit each micro-batch of ``jobs`` (ord, source, url, city_key, soft, legacy) against the registry.

    Batch n reads the registry that batch n - 1 left and replaces its own output and its own version
    of the registry, so a batch that runs again gives the same rows once.
    """

    def run(batch: DataFrame, n: int) -> None:
        from pyspark.sql.types import _parse_datatype_string

        registry = read_state(batch.sparkSession, f"{state_path}/after={n - 1}", _parse_datatype_string(REGISTRY))
        judged = cut(soft_block(batch, registry, as_of))
        replace_table(judged, f"{out_path}/batch={n}")
        replace_table(register(judged.filter("blocked_by is null"), registry, as_of), f"{state_path}/after={n}")

    return jobs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end into files of the shared folder; the driver holds no rows.

    A batch replaces its own folder; in complete mode only the last batch counts.
    """
    base, last = f"{shared_folder(spark)}/{name}", []

    def run(batch: DataFrame, n: int) -> None:
        replace_table(batch, f"{base}/rows/batch={n}")
        last.append(n)

    q = df.writeStream.foreachBatch(run).outputMode(mode).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    paths = sorted({f"{base}/rows/batch={n}" for n in (last if mode == "append" else last[-1:])})
    return spark.read.schema(df.schema).parquet(*paths) if paths else spark.createDataFrame([], df.schema)
