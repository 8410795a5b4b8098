"""Problem 6: check each new batch of links against everything accepted so far.

Method: content-defined chunking. The canonical link of a posting is cut where a rolling (gear)
hash of its last bytes hits a mask, so equal stretches give equal chunks wherever they stand.
Persistent tables lead from chunk to accepted record and from record to all of its chunks. The
bytes two links share in chunks decide: a pair that shares at least ``COVERAGE`` of the bytes of
the longer link is near; ``p6_found`` then confirms by the exact link. The records of a batch that
no earlier row has are appended.

Only the *prefix* of a record is in the chunk table: its chunks in one fixed order (by the number of
records that had them when the index was built, chunks not seen then first) up to the point where
what is left is too short for ``COVERAGE``. Two links that share that much must share a chunk of
both prefixes (prefix filter, exact), and the chunk of a site, which most records have, is neither
stored nor read.

Scale: both tables are split by hash into buckets of about ``BUCKET_ROWS`` records; their number is
fixed when the index is built. A batch reads the buckets that its own chunks and its candidates
fall into, as a list of folders, so what it reads depends on the batch and not on the history.
Every distinct posting is in the tables once, so a posting that makes up a third of all rows costs
one record. Batches are checked one after the other. No step emits pairs of rows.

Defined results: null, empty or blank links are never repeats and are not stored; a batch row is
a repeat when its posting was accepted or stands in a batch row with a smaller id; ties and
repeated rows give one line per repeating row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, let, query_reading, shared_folder
from .links import posting_key

#: Shortest chunk in bytes; a shorter tail joins the chunk before it.
MIN_CHUNK = 12
#: Boundary where these bits of the rolling hash are all zero (8 bytes of memory, 1 in 8).
MASK_SHIFT, MASK = 5, 7
#: Share of the longer link's bytes that near links share.
COVERAGE = 0.8
#: Records of a bucket, on average; the number of buckets follows from it and has these bounds.
BUCKET_ROWS, MOST_BUCKETS = 20_000, 1 << 16
REPEATS = "first_id bigint, feed_id bigint"
RECORD = "rec bigint, key string, chunks array<struct<h:bigint,len:int>>, bucket int"
POSTED = "h bigint, rec bigint, bucket int"
COMMON = "h bigint, df bigint, bucket int"


def chunks(key: Column, min_chunk: int = MIN_CHUNK) -> Column:
    """Content-defined chunks of ``key`` as array<struct<h bigint, len int>>; null for null."""
    n = F.length(key)
    start = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("last"), F.expr("array(0)").alias("cuts"))

    def step(a: Column, i: Column) -> Column:
        h = (F.shiftleft(a["h"], 1) + F.xxhash64(F.substring(key, i, F.lit(1))).bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.lit(0xFFFF))
        hit = (F.shiftrightunsigned(h, MASK_SHIFT).bitwiseAND(F.lit(MASK).cast("bigint")) == 0) & (i - a["last"] >= min_chunk) & (n - i >= min_chunk)
        return F.struct(
            h.alias("h"), F.when(hit, i).otherwise(a["last"]).alias("last"), F.when(hit, F.concat(a["cuts"], F.array(i))).otherwise(a["cuts"]).alias("cuts")
        )

    cuts = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda a: F.concat(a["cuts"], F.array(n)))

    def slices(c: Column) -> Column:
        def one(j: Column) -> Column:
            a, b = F.element_at(c, j), F.element_at(c, j + 1)
            return F.struct(F.xxhash64(F.substring(key, a + 1, b - a)).alias("h"), (b - a).alias("len"))

        return F.transform(F.sequence(F.lit(1), F.size(c) - 1), one)

    return F.when(n > 0, let(cuts, slices))


def prefix(cs: Column, coverage: float, common: Column) -> Column:
    """The chunks of ``cs`` that stand first in the fixed order until less than ``coverage`` of the bytes is left.

    ``common`` holds what the index counted, as array<struct<h, df>>; a chunk that is not there counts 0.
    """
    df = lambda h: F.coalesce(F.get(F.filter(common, lambda k: k["h"] == h), F.lit(0))["df"], F.lit(0).cast("bigint"))
    order = F.array_sort(F.transform(cs, lambda c: F.struct(df(c["h"]).alias("o"), c["h"].alias("h"), c["len"].alias("len"))))
    total = F.aggregate(cs, F.lit(0), lambda a, c: a + c["len"])
    start = F.struct(F.lit(0).alias("sum"), F.expr("array()").cast("array<bigint>").alias("hs"))

    def step(a: Column, c: Column) -> Column:
        more = a["sum"] <= (1 - coverage) * total + 1e-9
        return F.when(more, F.struct((a["sum"] + c["len"]).alias("sum"), F.concat(a["hs"], F.array(c["h"])).alias("hs"))).otherwise(a)

    return F.array_distinct(F.aggregate(order, start, step, lambda a: a["hs"]))


def shared_bytes(a: Column, b: Column) -> Column:
    """Bytes of the chunks of ``a`` that ``b`` has as well, over the bytes of the longer of the two."""
    size = lambda cs: F.aggregate(cs, F.lit(0), lambda s, c: s + c["len"])
    both = F.filter(a, lambda c: F.exists(b, lambda d: d["h"] == c["h"]))
    return size(both) / F.greatest(size(a), size(b))


class ChunkIndex:
    """Persistent tables of accepted postings: ``records`` (rec, key, chunks) and ``posted`` (h, rec), in buckets."""

    def __init__(self, spark: SparkSession, path: str | None = None, coverage: float = COVERAGE, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.coverage, self.bucket_rows = spark, coverage, bucket_rows
        self.path = path or f"{shared_folder(spark)}/index_{uuid.uuid4().hex}"
        self.buckets = 1

    def build(self, rows: DataFrame) -> "ChunkIndex":
        """First load: one record for each distinct posting of ``rows`` (``id``, ``key``)."""
        keys = cut(distinct_postings(rows))
        self.buckets = max(1, min(MOST_BUCKETS, -(-keys.count() // self.bucket_rows)))
        counted = keys.select(F.explode(F.array_distinct("chunks.h")).alias("h")).groupBy("h").agg(F.count("*").alias("df")).filter("df > 1").withColumn("bucket", self.bucket("h"))
        counted.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/common")
        self.append(keys)
        return self

    def _with_prefix(self, keys: DataFrame) -> DataFrame:
        """``keys`` and ``hs``, the chunks it is found by; the counts come by a join with the buckets that ``keys`` touch."""
        each = keys.select("rec", F.explode(F.array_distinct("chunks.h")).alias("h"))
        own = each.join(self._read("common", COMMON, each, "h"), "h").groupBy("rec").agg(F.collect_list(F.struct("h", "df")).alias("_common"))
        counts = F.coalesce("_common", F.expr("cast(array() as array<struct<h:bigint,df:bigint>>)"))
        return keys.join(own, "rec", "left").withColumn("hs", prefix(F.col("chunks"), self.coverage, counts)).drop("_common")

    def bucket(self, c: Column | str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def append(self, keys: DataFrame) -> None:
        """Add distinct postings; ``keys`` has ``rec``, ``key``, ``chunks`` and may have ``hs``."""
        keys = keys if "hs" in keys.columns else cut(self._with_prefix(keys))
        keys.select("rec", "key", "chunks", self.bucket("rec").alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "rec").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/records")
        keys.select(F.explode("hs").alias("h"), "rec").withColumn("bucket", self.bucket("h")).repartition("bucket").sortWithinPartitions("bucket", "h").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/posted")

    def _read(self, table: str, schema: str, wanted: DataFrame, column: str) -> DataFrame:
        """The rows of ``table`` in the buckets that ``column`` of ``wanted`` falls into: those folders are listed and read, no others."""
        numbers = sorted(r.b for r in wanted.select(self.bucket(column).alias("b")).distinct().collect())  # at most the number of buckets
        jvm = self.spark.sparkContext._jvm
        at = [jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/bucket={b}") for b in numbers]
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        there = [p.toString() for p in at if fs.exists(p)]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*there) if there else self.spark.createDataFrame([], schema)

    def near(self, keys: DataFrame) -> DataFrame:
        """``rec, known, coverage, exact``: accepted records ``known`` that share enough bytes with a record of ``keys`` (with ``hs``)."""
        asked = keys.select("rec", F.explode("hs").alias("h"))
        posted = self._read("posted", POSTED, asked, "h").select("h", F.col("rec").alias("known"))
        candidates = cut(asked.join(posted, "h").select("rec", "known").distinct())
        records = self._read("records", RECORD, candidates, "known").select(F.col("rec").alias("known"), F.col("key").alias("_key"), F.col("chunks").alias("_chunks"))
        judged = candidates.join(records, "known").join(keys.select("rec", "key", "chunks"), "rec").withColumn("coverage", shared_bytes(F.col("chunks"), F.col("_chunks")))
        return judged.filter(F.col("coverage") >= self.coverage).select("rec", "known", "coverage", (F.col("key") == F.col("_key")).alias("exact"))


def distinct_postings(rows: DataFrame) -> DataFrame:
    """``rec, key, chunks`` of each distinct key of ``rows`` (``id``, ``key``); missing keys leave."""
    return rows.filter("key is not null").groupBy("key").agg(F.min("id").alias("rec")).select("rec", "key", chunks(F.col("key")).alias("chunks"))


def check_batch(index: ChunkIndex, batch: DataFrame, out: str) -> None:
    """Write the repeats of one batch (``id``, ``key``) to ``out`` and append its new postings."""
    keys = cut(index._with_prefix(cut(distinct_postings(batch))))
    known = index.near(keys).filter("exact").groupBy("rec").agg(F.min("known").alias("known"))
    seen = cut(keys.join(known, "rec", "left"))
    (
        batch.filter("key is not null").join(seen.select("key", F.coalesce("known", "rec").alias("first_id")), "key")
        .filter("first_id < id").select("first_id", F.col("id").alias("feed_id"))
        .write.mode("append").parquet(out)
    )
    index.append(seen.filter("known is null").drop("known"))


def repeated_postings(accepted: DataFrame, batches: DataFrame, **layout) -> DataFrame:
    """``first_id, feed_id`` of every batch row whose posting came before.

    The accepted rows fill the index once; each batch, in order, is then a run of its own.
    """
    spark = accepted.sparkSession
    index = ChunkIndex(spark, **layout).build(accepted.select(F.col("feed_id").alias("id"), posting_key(F.col("url")).alias("key")))
    rows = cut(batches.select("batch_no", F.col("feed_id").alias("id"), posting_key(F.col("url")).alias("key")))
    out = f"{index.path}/repeats"
    spark.createDataFrame([], REPEATS).write.parquet(out)
    for (no,) in rows.select("batch_no").distinct().orderBy("batch_no").collect():
        check_batch(index, rows.filter(F.col("batch_no").eqNullSafe(no)).drop("batch_no"), out)
    return spark.read.schema(REPEATS).parquet(out)


@query_reading("accepted_urls", "batch_urls")
def p6_found(accepted: DataFrame, batches: DataFrame) -> DataFrame:
    """Repeated postings of the batches."""
    return repeated_postings(accepted, batches)


QUERIES = {"p6_found": p6_found}
