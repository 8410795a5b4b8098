"""Bucket files: drop sets, first link wins, order, cap, counters; source health; alerts and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import url_norm
from .checkpoint import cut
from .relational import first_per_key


def reason_tag(c: str = "reason") -> Column:
    """The leading tag of a reason, before the first colon."""
    return F.trim(F.substring_index(F.col(c), ":", 1))


def drop_causes(rows: DataFrame, drops: list[tuple[str, DataFrame]]) -> DataFrame:
    """``cause``: name of the first drop set (of one column ``url``) that holds the row's link; null if none."""
    out = rows.withColumn("_u", url_norm("url"))
    for i, (_, d) in enumerate(drops):
        keys = d.select(url_norm("url").alias("_u")).filter("_u <> ''").distinct().withColumn(f"_d{i}", F.lit(True))
        out = out.join(keys, "_u", "left")
    cause = F.coalesce(*(F.when(F.col(f"_d{i}"), F.lit(name)) for i, (name, _) in enumerate(drops)), F.lit(None).cast("string"))
    return out.withColumn("cause", F.when(F.col("_u") != "", cause)).drop("_u", *(f"_d{i}" for i in range(len(drops))))


def finish_bucket(rows: DataFrame, drops: list[tuple[str, DataFrame]], cap: int | None, order: list) -> DataFrame:
    """Every row with its fate: kept, or dropped for a drop set, a repeated link or the cap (``order`` ascends).

    Only links are windowed for repeats (rows without one leave first), and the cap takes a
    top-k instead of ranking all rows in one task.
    """
    tagged = cut(drop_causes(rows, drops).withColumn("_id", F.monotonically_increasing_id()))
    alive = tagged.filter("cause is null")
    once = cut(first_per_key(alive, url_norm("url"), order))
    kept = once.orderBy(*order).limit(cap) if cap is not None else once
    mark = lambda df, name: df.select("_id").withColumn(name, F.lit(True))
    out = tagged.join(mark(once, "_once"), "_id", "left").join(mark(kept, "_kept"), "_id", "left")
    fate = F.when(F.col("cause").isNotNull(), F.col("cause")).when(F.col("_once").isNull(), "dup-url").when(F.col("_kept").isNull(), "cap").otherwise("kept")
    return out.withColumn("fate", fate).drop("_once", "_kept", "cause", "_id")


def count_by_reason(rows: DataFrame) -> DataFrame:
    """Counts in the order of a counter: most first, ties by first appearance."""
    return rows.groupBy(reason_tag().alias("tag")).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def source_health(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """State of each known source against its history, and the history after this run.

    dark: had 5 or more and now none; partial: below 30 % of its best; never: third run of nothing.
    ``counts`` (source, n; -1 = failed), ``stats`` (source, best, zero_runs).
    """
    x = stats.join(counts, "source", "full_outer").select("source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("best", F.lit(0)).alias("best"), F.coalesce("zero_runs", F.lit(0)).alias("zero_runs"))
    zero = F.when(F.col("n") <= 0, F.col("zero_runs") + 1).otherwise(0)
    state = (
        F.when((F.col("best") >= 5) & (F.col("n") <= 0), "dark").when((F.col("best") >= 5) & (F.col("n") < 0.3 * F.col("best")), "partial")
        .when((F.col("best") == 0) & (zero >= 3), "never").otherwise("ok")
    )
    return x.withColumn("state", state).withColumn("new_best", F.greatest("best", "n")).withColumn("new_zero_runs", zero)


def alert_batches(rows: DataFrame, per_message: int = 10, limit: int = 60) -> DataFrame:
    """Rows to send, referrals first: the first ``limit``, in messages of ``per_message``."""
    top = rows.orderBy(F.col("referral").desc(), "ord").limit(limit)
    w = Window.orderBy(F.col("referral").desc(), "ord")  # at most ``limit`` rows
    return top.withColumn("rn", F.row_number().over(w)).withColumn("message", F.floor((F.col("rn") - 1) / per_message).cast("int"))


def digest_new(items: DataFrame, memory: DataFrame, as_of: str, days: int = 120) -> DataFrame:
    """Items that no fresh key of ``memory`` (k, seen) blocks: link, title|region, or title|* where the region is unknown."""
    fresh = memory.filter(F.col("seen") >= F.date_sub(F.to_date(F.lit(as_of)), days).cast("string")).select("k").distinct()
    keys = F.array(
        F.concat(F.lit("u:"), url_norm("url")), F.concat(F.lit("t:"), F.col("title_key"), F.lit("|"), F.col("region")),
        F.when(F.col("region") == "Unknown", F.concat(F.lit("t:"), F.col("title_key"), F.lit("|*"))),
    )
    hit = items.select("ord", F.explode(keys).alias("k")).filter("k is not null").join(fresh, "k", "left_semi").select("ord").distinct()
    return items.join(hit, "ord", "left_anti")
