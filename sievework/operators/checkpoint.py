"""Lineage cuts through the shared checkpoint folder."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which every executor reaches.

    Where it is unset, a session on one machine (tests) sets a temporary folder of its own; on a
    cluster there is no safe place, and this fails.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
        folder = tempfile.mkdtemp(prefix="sievework_")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


class Scratch:
    """Compressed tables in the shared folder that one query needs for a while; all are gone when the block ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, f"{shared_folder(spark)}/scratch_{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Append ``df`` to table ``name`` and go on from its files; shuffles that nothing else refers to are freed."""
        path, schema = f"{self.path}/{name}", df.schema
        df.write.mode("append").option("compression", "zstd").parquet(path)
        del df
        # shuffle files go when the driver's JVM collects the plans that wrote them, and left alone that may be never
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table, by default all."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
