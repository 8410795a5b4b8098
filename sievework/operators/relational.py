"""Order-aware relational operators: first wins, capped, round-robin, budgeted, suppressed.

List order is carried in an explicit column (``ord``) and ends every sort key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_key, text
from .checkpoint import cut


def first_per_key(df: DataFrame, key: Column, order: list, keep_empty: bool = True) -> DataFrame:
    """The first row of each key by ``order`` (ascending, unique); rows with an empty key are all kept.

    The least row is an aggregate that combines on the map side, so a key with a third of all rows
    costs one row a task; rows without a key leave before it.
    """
    keyed = df.withColumn("_key", key)
    empty = F.col("_key").isNull() | (F.col("_key") == "")
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    first = keyed.filter(~empty).groupBy("_key").agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")
    return first.unionByName(keyed.filter(empty).drop("_key")) if keep_empty else first


def merge_new_over_existing(new: DataFrame, existing: DataFrame, key: Column, order: list) -> DataFrame:
    """Bag union in which a new row replaces the existing row of its key."""
    both = new.withColumn("_age", F.lit(0)).unionByName(existing.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, key, [F.col("_age"), *order]).drop("_age")


def dedup_cross_source(jobs: DataFrame) -> DataFrame:
    """Merge one role seen at several sources; two postings of one source never merge.

    The r-th distinct posting of a source under a key lands in the r-th merged row, which is what
    placing rows one by one would give. Masked employers collapse only by source and sid. A merged
    row has at most one posting of each source, so its members are no more than there are sources.
    """
    co = norm_key("company")
    keyed = jobs.withColumn("_co", co).withColumn(
        "_k",
        F.when(F.col("_co") != "", F.concat_ws("\u0001", F.col("_co"), F.left(norm_key("title"), F.lit(40)), text("region"))).otherwise(F.concat_ws("\u0002", text("source"), text("sid"))),
    )
    once = first_per_key(keyed, F.concat_ws("\u0003", "_k", text("source"), text("sid")), [F.col("ord")])
    ranked = once.withColumn("_r", F.row_number().over(Window.partitionBy("_k", "source").orderBy("ord")))
    member = F.struct("ord", text("source").alias("source"), text("sid").alias("sid"), text("url").alias("url"), text("title").alias("title"))
    return (
        ranked.groupBy("_k", "_r")
        .agg(F.min_by(F.struct("ord", "company", "title", "region", "city", "url"), "ord").alias("head"), F.array_sort(F.collect_list(member)).alias("members"), F.array_sort(F.collect_set(text("source"))).alias("sources"))
        .select("head.*", "members", "sources", F.size("members").alias("n_members"))
    )


def newest_per_group(df: DataFrame, group: list[str], newest: list, n: int, uncapped: Column | None = None) -> DataFrame:
    """The ``n`` newest rows of each group; rows for which ``uncapped`` holds are all kept.

    Uncapped rows pass beside the window, whose rank filter then limits each group on the map side.
    """
    free = F.coalesce(uncapped, F.lit(False)) if uncapped is not None else F.lit(False)
    ranked = df.filter(~free).withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*newest))).filter(F.col("_rn") <= n).drop("_rn")
    return ranked.unionByName(df.filter(free)) if uncapped is not None else ranked


def round_robin(df: DataFrame, lane: str, order: list, per_lane: int, total: int) -> DataFrame:
    """Rows dealt lane by lane: at most ``per_lane`` of a lane and ``total`` in all; ``turn`` is the rank."""
    inside = df.withColumn("_rn", F.row_number().over(Window.partitionBy(lane).orderBy(*order))).filter(F.col("_rn") <= per_lane)
    # after the cap per lane a window over all rows holds at most lanes x per_lane of them
    return inside.withColumn("turn", F.row_number().over(Window.orderBy("_rn", lane))).filter(F.col("turn") <= total).drop("_rn")


def cap_protected(df: DataFrame, protected: Column, cap: int, keep_first: list) -> DataFrame:
    """At most ``cap`` rows, unprotected ones kept in the given order as far as there is room; protected rows all stay.

    What is ranked is a top-k of the rows to keep, at most ``cap`` of them; the others are never sorted.
    """
    safe = F.coalesce(protected, F.lit(False))
    room = max(0, cap - df.filter(safe).limit(cap).count())
    return df.filter(safe).unionByName(df.filter(~safe).orderBy(*keep_first).limit(room))


def budget_prefix(df: DataFrame, group: list[str], order: list, size: Column, budget: int, most: int) -> DataFrame:
    """The prefix of each group that fits the budget: at most ``most`` rows, the first always.

    The rank limits each group to ``most`` rows on the map side before sizes are summed up.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    head = df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
    running = F.sum(size).over(Window.partitionBy(*group).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    return head.withColumn("used", running).filter((F.col("rn") == 1) | (F.col("used") <= budget))


def suppress_within_run(df: DataFrame, key: str, masked: Column) -> DataFrame:
    """``blocked_by``: link of the first row of the key when it comes from another source (or is masked).

    The owner of a key is an aggregate that combines on the map side and is joined back; rows
    without a key never block and stay out of both. The rows are written once first, as their keys
    are dear to compute and are read three times.
    """
    df = cut(df.withColumn("_masked", masked))
    masked = F.col("_masked")
    keyed = df.filter(F.col(key).isNotNull())
    owners = keyed.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct("ord", "source", "url"), "ord").alias("_f"))
    owned = (F.col("_f.ord") < F.col("ord")) & (masked | ~F.col("source").eqNullSafe(F.col("_f.source")))
    judged = keyed.join(owners, F.col(key) == F.col("_k")).withColumn("blocked_by", F.when(owned, text("_f.url"))).drop("_f", "_k")
    return judged.unionByName(df.filter(F.col(key).isNull()).withColumn("blocked_by", F.lit(None).cast("string"))).drop("_masked")


def two_feed_union(first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer union of two feeds by key; the first feed's fields win where present."""
    a, b = first.alias("a"), second.alias("b")
    out = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return out.select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key), *(F.coalesce(F.nullif(F.trim(f"a.{c}"), F.lit("")), F.col(f"b.{c}")).alias(c) for c in columns),
        F.when(F.col(f"b.{key}").isNull(), "first").when(F.col(f"a.{key}").isNull(), "second").otherwise("both").alias("feed"),
    )


def enrich_within_budget(listing: DataFrame, detail: DataFrame, key: str, order: list, budget: int, field: str) -> DataFrame:
    """Left join of details for the first ``budget`` rows only; the rest keeps an empty field."""
    chosen = listing.orderBy(*order).limit(budget).select(key).withColumn("_chosen", F.lit(True))
    full = chosen.join(detail.select(key, field), key, "left")
    return listing.join(full, key, "left").withColumn("enriched", F.coalesce("_chosen", F.lit(False))).withColumn(field, F.coalesce(field, F.lit(""))).drop("_chosen")


def longest_rule(df: DataFrame, value: Column, rules: DataFrame, key: str, out: str) -> DataFrame:
    """Each row's longest rule contained in ``value``.

    Distinct values are cut into substrings of the lengths that rules have, which meet the rules in
    an equality join, however many rules there are; a value costs its length times the number of
    lengths. ``rules`` has each ``key`` once.
    """
    lengths = F.broadcast(rules.filter(F.length(key) > 0).agg(F.sort_array(F.collect_set(F.length(key))).alias("_ls")))  # one row
    values = df.select(value.alias("_v")).filter("_v <> ''").distinct()
    at = F.transform("_ls", lambda n: F.when(F.length("_v") >= n, F.transform(F.sequence(F.lit(1), F.length("_v") - n + 1), lambda i: F.substring(F.col("_v"), i, n))))
    cut = values.join(lengths).select("_v", F.explode(F.array_distinct(F.flatten(F.filter(at, lambda x: x.isNotNull())))).alias(key))
    best = cut.join(rules.select(key, out), key).groupBy("_v").agg(F.max_by(F.struct(key, out), F.struct(F.length(key), F.col(key))).alias("_b"))
    return df.withColumn("_v", value).join(best, "_v", "left").withColumn(out, F.col(f"_b.{out}")).withColumn("rule", F.col(f"_b.{key}")).drop("_b", "_v")
