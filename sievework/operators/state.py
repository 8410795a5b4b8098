"""State across runs: permanent ids, soft keys with a time to live, retry queue, staged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUPPRESS_DAYS = 30


def expired(seen: Column, as_of: str, days: int = SUPPRESS_DAYS) -> Column:
    """More than ``days`` old; an unreadable date never expires."""
    return F.coalesce(F.datediff(F.to_date(F.lit(as_of)), F.to_date(F.try_to_timestamp(seen, F.lit("yyyy-MM-dd")))) > days, F.lit(False))


def known_members(members: DataFrame, seen: DataFrame) -> DataFrame:
    """Keys of merged rows (k, id) of which any member id is in the registry."""
    return members.join(seen.select("id").distinct(), "id", "left_semi").select("k").distinct()


def soft_block(jobs: DataFrame, registry: DataFrame, as_of: str, days: int = SUPPRESS_DAYS) -> DataFrame:
    """``blocked_by``: link of the owner of the first blocking key; null = admitted.

    ``jobs``: ord, source, city_key, soft, legacy (null = retired). A key blocks while it is not
    expired, unless the same source owns it in another city. ``registry``: k, seen, u, src, city.
    """
    out = jobs
    for name in ("soft", "legacy"):
        r = registry.select(F.col("k").alias(name), F.struct("seen", "u", "src", "city").alias(f"_{name}"))
        v = F.col(f"_{name}")
        elsewhere = (F.coalesce(v["src"], F.lit("")) != "") & (v["src"] == F.col("source")) & v["city"].isNotNull() & (v["city"] != F.col("city_key"))
        blocks = v.isNotNull() & ~expired(v["seen"], as_of, days) & ~F.coalesce(elsewhere, F.lit(False))
        out = out.join(r, name, "left").withColumn(f"_b_{name}", F.when(blocks, F.coalesce(v["u"], F.lit(""))))
    return out.withColumn("blocked_by", F.coalesce("_b_soft", "_b_legacy")).drop("_soft", "_legacy", "_b_soft", "_b_legacy")


def register(admitted: DataFrame, registry: DataFrame, as_of: str) -> DataFrame:
    """The registry after a run: admitted rows own their soft key; the last of a key wins over older ones."""
    new = (
        admitted.filter("soft is not null").groupBy(F.col("soft").alias("k")).agg(F.max_by(F.struct(F.col("url").alias("u"), F.col("source").alias("src"), F.col("city_key").alias("city")), "ord").alias("v"))
        .select("k", F.lit(as_of).alias("seen"), "v.u", "v.src", "v.city")
    )
    return new.unionByName(registry.join(new.select("k"), "k", "left_anti").select(new.columns))


def admitted_by_ttl(events: DataFrame, key: list[str], ts: str, days: int) -> DataFrame:
    """First event of each key, and each that comes more than ``days`` after the last admitted one.

    A fold over the sorted days of a key: duplicates of a day fall together first, so the array of
    a key is bounded by the days covered, however many events it has.
    """
    daily = events.groupBy(*key, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    start = F.struct(F.lit(None).cast("date").alias("last"), F.expr("array()").cast("array<date>").alias("out"))

    def step(a: Column, d: Column) -> Column:
        ok = a["last"].isNull() | (F.datediff(d, a["last"]) > days)
        return F.struct(F.when(ok, d).otherwise(a["last"]).alias("last"), F.when(ok, F.concat(a["out"], F.array(d))).otherwise(a["out"]).alias("out"))

    return daily.groupBy(*key).agg(F.aggregate(F.array_sort(F.collect_list("day")), start, step, lambda a: a["out"]).alias("days")).select(*key, F.explode("days").alias("day"))


def retry_queue(queue: DataFrame, sent: DataFrame, overflow: DataFrame, delivered: bool, as_of: str, most: int = 60, days: int = 14) -> DataFrame:
    """The queue after a run: nothing after success, else the failed head and the overflow, fresh ones only."""
    if delivered:
        return overflow.filter(F.lit(False))
    both = sent.withColumn("_p", F.lit(0)).unionByName(overflow.withColumn("_p", F.lit(1))).unionByName(queue.withColumn("_p", F.lit(2)), allowMissingColumns=True)
    return both.filter(~expired(F.col("queued"), as_of, days)).orderBy("_p", "ord").limit(most).drop("_p")


def read_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A state table; a missing one is a fresh start, a corrupt one aborts."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").parquet(path)


def replace_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite by writing beside the table and renaming: readers see the old or the new one, never a part.

    Between the two renames there is no table for a moment; one writer at a time is assumed.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = f"{path}.new_{uuid.uuid4().hex}", f"{path}.old_{uuid.uuid4().hex}"
    df.write.format(fmt).save(new)
    p = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(conf)
    had = fs.exists(p(path)) and fs.rename(p(path), p(old))
    if not fs.rename(p(new), p(path)):
        if had:
            fs.rename(p(old), p(path))
        raise OSError(f"cannot replace {path}")
    if had:
        fs.delete(p(old), True)
