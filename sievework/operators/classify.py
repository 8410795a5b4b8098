"""Rule classification of postings into lanes, and routing of every row to its buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import text as T
from ..functions.rules import RULES, Rules



def is_student(title, r: Rules = RULES) -> Column:
    starts = F.trim(T.text(title)).rlike(rf"^(?:{T.quoted(r.student_start)})")
    return T.has_word(title, r.student_words) | T.has(title, r.student_he) | starts


def is_experienced(title, r: Rules = RULES) -> Column:
    return T.has_word(title, r.experienced) | T.has(title, r.experienced_he)


def is_foundation(title, desc, r: Rules = RULES) -> Column:
    """A skipped field by the title alone, or by a title that the text decides."""
    return T.has_word(title, r.skip_words) | T.has(title, r.guarded) & T.has_word(desc, r.guards)


def is_manual_test(title, desc, r: Rules = RULES) -> Column:
    """Testing by hand: said so, or a tester's title without tools of automation in the text."""
    return T.has_word(title, r.tester) & ~T.has(title, r.automated) & (T.has(title, r.manual) | (T.count_words(desc, r.automation_tools) < r.min_tools))


def is_senior(title, r: Rules = RULES) -> Column:
    return T.has(title, r.senior) | T.has_word(title, r.senior_words)


def passes_gate(title, r: Rules = RULES) -> Column:
    return T.has(title, r.gate) | T.has_word(title, r.gate_words)


def is_profile_gap(title, r: Rules = RULES) -> Column:
    """A gap term, unless the head of the title speaks of the core and not of the gap."""
    head = T.head_of_title(title)
    return T.has_term(title, r.gap_terms) & (T.has_term(head, r.gap_terms) | ~T.has_term(head, r.core_terms))


def normalize(df: DataFrame) -> DataFrame:
    """Fixed posting schema: missing texts are '', levels lower case, only years may be null."""
    texts = {c: T.text(c) for c in ("source", "sid", "title", "company", "city", "url", "desc", "region")}
    return df.withColumns(texts | {"level": F.lower(T.text("level")), "active": F.coalesce("active", F.lit(True)), "tech": F.coalesce("tech", F.expr("array()").cast("array<string>"))})


def facts(df: DataFrame, r: Rules = RULES) -> DataFrame:
    """The predicates that the decision list reads, each computed once over texts folded once."""
    low = df.withColumns({"_t": F.lower(T.text("title")), "_d": F.lower(T.text("desc"))})
    return low.withColumns(
        {
            "gate": passes_gate("_t", r), "senior_title": is_senior("_t", r), "student": is_student("_t", r) | (F.col("source").isin(*r.student_level_sources) & (F.lower(T.text("level")) == "student")),
            "junior_title": T.has("_t", r.junior), "junior_level": F.lower(T.text("level")).isin(*r.junior_levels), "ymin": F.coalesce("years_min", X.parse_years("desc")),
            "experienced": is_experienced("_t", r), "foundation": is_foundation("_t", "_d", r), "manual": is_manual_test("_t", "_d", r), "industrial": T.has_word("_t", r.industrial),
            "bench": T.has("_t", r.bench_test), "training": T.has("_t", r.training), "gap": is_profile_gap("_t", r), "qa": T.has_word("_t", r.qa_words),
            "giant": T.company_is("company", r.giants), "referral": T.company_is("company", r.referral), "verified": F.length(F.trim(T.text("desc"))) > 60, "signals": T.count_words("_d", r.signals),
        }
    ).drop("_t", "_d")


def classify(f: DataFrame, r: Rules = RULES) -> DataFrame:
    """``lane, why, fit, tailor`` by an ordered decision list over ``facts``; null lane = gate missed."""
    c, why = F.col, r.reasons
    y, known = c("ymin"), c("referral") | c("giant")
    junior = c("junior_title") | c("junior_level") | F.coalesce(y <= 2, F.lit(False))
    senior = c("senior_title") | F.coalesce(y >= 3, F.lit(False))
    over = F.coalesce(y >= 4, F.lit(False))
    three = F.coalesce(y == 3, F.lit(False))
    lane = lambda name, reason, tailor=F.lit(False): F.struct(F.lit(name).alias("lane"), F.lit(why[reason]).alias("why"), tailor.alias("tailor"))
    yes = F.lit(True)
    first = F.when(~c("gate"), F.lit(None).cast("struct<lane:string,why:string,tailor:boolean>"))
    for fact in ("bench", "manual", "industrial", "training", "foundation", "student"):
        first = first.when(c(fact), lane("skip", fact))
    first = (
        first.when(c("junior_title") & ~c("senior_title") & over, lane("review", "years"))
        .when(c("experienced") & ~c("senior_title") & ~over, lane("reach", "experienced", three | known))
        .when(known & (c("senior_title") | over), lane("skip", "known_senior")).when(known & three, lane("reach", "known_three", yes))
        .when(known & junior, lane("apply", "junior")).when(known, lane("reach", "known", yes))
        .when(junior & ~senior, lane("apply", "junior")).when(c("senior_title") | over, lane("skip", "senior")).when(three, lane("reach", "three", yes))
        .otherwise(lane("review", "open"))
    )
    out = f.withColumn("_l", first)
    pure = (y == 0) | (y.isNull() & (c("junior_title") | c("junior_level")))
    gap = c("gap") & c("_l.lane").isin("apply", "reach")
    learn = gap & (c("_l.lane") == "apply") & F.coalesce(pure, F.lit(False))
    out = out.withColumns(
        {
            "lane": F.when(gap & ~learn, "reach").otherwise(c("_l.lane")),
            "why": F.when(learn, why["learn"]).when(gap, why["gap"]).otherwise(c("_l.why")),
            "tailor": F.coalesce(F.when(gap & ~learn, False).otherwise(c("_l.tailor")) & c("verified"), F.lit(False)),
        }
    )
    fit = (
        F.when(c("lane").isNull(), F.lit(None).cast("int")).when(c("referral") & (c("lane") != "skip"), 5).when(c("lane") == "apply", F.when(c("region") == "North", 5).otherwise(4))
        .when(c("lane").isin("reach", "review"), F.when(known, 4).otherwise(3)).otherwise(1)
    )
    return out.withColumn("fit", fit).drop("_l")


def routed(c: DataFrame, r: Rules = RULES) -> DataFrame:
    """``routes``: every bucket a row goes to with the reason, and ``on_page``; one pass, many outputs."""
    x = F.col
    route = lambda cond, bucket, reason: F.when(cond, F.struct(F.lit(bucket).alias("bucket"), reason.alias("reason")))
    kept = ~x("region").isin(*r.drop_regions) & x("active")
    tag = F.when(x("senior_title"), "senior").when(x("student"), "student").otherwise("open")
    missed = x("lane").isNull()
    known = x("giant") | x("referral")
    qa = x("qa")
    routes = F.array(
        route(kept & x("giant"), "giant", F.concat(F.lit("giant:"), tag)),
        route(kept & missed & qa, "qa", F.lit("qa:not-dev-title")),
        route(kept & missed & ~qa & known, "review", F.lit("not-dev-title")),
        route(kept & missed & ~qa & ~known & (x("signals") >= r.min_signals), "review", F.lit("jd-signal")),
        route(kept & missed & ~qa & ~known & (x("signals") < r.min_signals) & ~x("verified") & ~x("senior_title"), "review", F.lit("no-jd-title")),
        route(kept & (x("lane") == "skip") & qa, "qa", F.concat(F.lit("qa:"), x("why"))),
        route(kept & (x("lane") == "skip") & ~qa, "review", x("why")),
        route(kept & (x("lane") == "review"), "review", F.concat(F.lit("review:"), x("why"))),
    )
    page = kept & (x("lane").isin("apply", "reach") | ((x("lane") == "review") & x("region").isin(*r.page_regions)))
    return c.withColumn("routes", F.filter(routes, lambda v: v.isNotNull())).withColumn("on_page", F.coalesce(page, F.lit(False)))


def only(df: DataFrame, keep: str) -> DataFrame:
    """Rows for which column ``keep`` holds, without a copy of its whole expression in a pushed filter."""
    return df.withColumn("_keep", F.explode_outer(F.array(F.col(keep)))).filter("_keep").drop("_keep")


def bucket_rows(c: DataFrame) -> DataFrame:
    """One row for each route, in the shape of a bucket file.

    The outer explode keeps the optimizer from copying the whole decision list into a filter.
    """
    return c.select("ord", F.explode_outer("routes").alias("r"), "company", "title", "url", "region", "city", "source", F.left(T.text("desc"), F.lit(700)).alias("desc"), "junior_title").filter("r is not null").select(
        "ord", "r.bucket", "r.reason", "company", F.col("title").alias("role"), "url", "region", F.col("city").alias("loc"), F.col("source").alias("src"), "desc", "junior_title"
    )


def rule_failure(r: Rules = RULES) -> Column:
    """First rule an existing row (role, region) fails now; null if none."""
    return (
        F.when(T.has_word("role", r.skip_words), r.reasons["foundation"]).when(is_senior("role", r), "senior").when(is_student("role", r), "student")
        .when(F.col("region").isin(*r.drop_regions), F.concat(F.lit("region-"), F.col("region")))
    )
