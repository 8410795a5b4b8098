"""A Python data source over a folder of board payloads: one partition for each board.

``spark.read.format("landed_boards").option("path", folder).load()`` gives one row for each item
of ``<folder>/<board>.json`` (``{"items": [...]}`` or a list); a board that cannot be read gives
one row with its error and no item, so a failure never stops the scan.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class BoardPartition(InputPartition):
    def __init__(self, board: str, path: str):
        self.board, self.path = board, path


class BoardReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]

    def partitions(self):
        import os

        return [BoardPartition(f[:-5], os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder)) if f.endswith(".json")] or [BoardPartition("", "")]

    def read(self, partition):
        import json

        if not partition.path:
            return
        try:
            with open(partition.path, encoding="utf-8") as f:
                doc = json.load(f)
            items = doc if isinstance(doc, list) else doc.get("items") or []
            for i, item in enumerate(items):
                yield partition.board, i, json.dumps(item, ensure_ascii=False), None
        except (OSError, ValueError, AttributeError) as e:
            yield partition.board, -1, None, f"{type(e).__name__}: {e}"


class LandedBoards(DataSource):
    """Folder of JSON payloads, one file for each board."""

    @classmethod
    def name(cls) -> str:
        return "landed_boards"

    def schema(self) -> str:
        return "board string, pos int, item string, error string"

    def reader(self, schema):
        return BoardReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(LandedBoards)
