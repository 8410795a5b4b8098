"""Problem 9: mix sources to target shares of all tokens.

Method: aggregate the tokens of each source, derive a repetition rate for each, then emit every
document floor(rate) times plus one copy that a hash-seeded Bernoulli trial grants with the
probability of the fraction.

Rates: of a total of T tokens (by default as many as the listed sources have) each source is to
supply share x T, so its rate is that number over its own tokens, at most ``max_repeats``. A source
at that limit is repeated as often as it may be, and its shortfall is reported and not made up by
others: shares of the other sources relative to each other stay as asked for. Most of a rate above
one is its whole part, which is exact; the Bernoulli part has an expected error, the square root of
f (1 - f) x the sum of squared sizes, which the report states for each source as a share of the mix.

Scale: tokens are counted once in a scan and kept in a checkpoint; per-source sums are partial
aggregates; the rates (one row per listed source) are joined by a checked broadcast; copies are
made by explode of a sequence of at most ``max_repeats`` numbers. A source with a third of all
rows is never shuffled.

Defined results: unlisted sources and null sources are left out (share 0); listed sources
without documents report 0; null and empty texts have 0 tokens and are emitted like others;
repeated rows are drawn by their own ids; equal seeds give equal mixes at any partitioning;
empty tables give an empty mix and a report of zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import checked_broadcast, cut, query_reading
from .p08_tokens import count_tokens

SEED = 20_240_101


def repetition_rates(counted: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """``source, target_share, max_repeats, n_docs, tokens, squares, rate``, one row per listed source."""
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("squares"), F.count("*").alias("n_docs"))
    zero = F.lit(0).cast("bigint")
    rows = targets.join(sums, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("squares", F.lit(0.0)).alias("squares")
    )
    every = Window.partitionBy()  # one row per listed source: the list is the bound
    t = F.lit(float(total)) if total is not None else F.sum("tokens").over(every)
    rate = F.when(F.col("tokens") > 0, F.least(F.col("target_share") * F.col("t") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return rows.withColumn("t", t).withColumn("rate", rate).drop("t")


def draw(counted: DataFrame, rates: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``<key>, source, copy_no, n_tokens``: the copies of the mix."""
    whole = F.floor("rate").cast("int")
    uniform = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    n = whole + F.when(uniform < F.col("rate") - whole, 1).otherwise(0)
    return (
        counted.join(checked_broadcast(rates.select("source", "rate")), "source")
        .withColumn("n", n).filter("n > 0")
        .select(key, "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"), "n_tokens")
    )


def report(mix: DataFrame, rates: DataFrame) -> DataFrame:
    """Target and actual share of each listed source, and the error to expect of the actual one."""
    got = mix.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"), F.count("*").alias("mix_docs"), F.max("copy_no").alias("most_copies"))
    every = Window.partitionBy()
    zero = F.lit(0).cast("bigint")
    out = rates.join(got, "source", "left").withColumn("mix_tokens", F.coalesce("mix_tokens", zero))
    of_mix = lambda c: F.when(F.sum("mix_tokens").over(every) > 0, c / F.sum("mix_tokens").over(every)).otherwise(0.0)
    f = F.col("rate") - F.floor("rate")
    return out.select(
        "source", "target_share", of_mix(F.col("mix_tokens")).alias("actual_share"), of_mix(F.sqrt(f * (1 - f) * F.col("squares"))).alias("share_error"), "rate",
        (F.col("rate") >= F.col("max_repeats")).alias("at_limit"), "n_docs", "tokens", F.coalesce("mix_docs", zero).alias("mix_docs"), "mix_tokens", F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )


def _counted(documents: DataFrame, targets: DataFrame) -> DataFrame:
    listed = documents.join(checked_broadcast(targets.select("source").distinct()), "source", "left_semi")
    return cut(count_tokens(listed, ("doc_id", "source")))


@query_reading("documents", "mix_targets")
def p9_mix(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """The copies of the mix."""
    counted = _counted(documents, targets)
    return draw(counted, cut(repetition_rates(counted, targets)))


@query_reading("documents", "mix_targets")
def p9_report(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual shares of the mix."""
    counted = _counted(documents, targets)
    rates = cut(repetition_rates(counted, targets))
    return report(draw(counted, rates), rates)


QUERIES = {"p9_mix": p9_mix, "p9_report": p9_report}
