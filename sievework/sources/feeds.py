"""Declarative adapters over landed payloads: parse, filter, dedup, cap, enrich.

A feed is a :class:`Feed`: how to cut the payload into items and which expression gives each
posting field. Five readers cover the families of payloads - JSON documents (nested lists,
cursors, boards), HTML cards, JSON embedded in HTML, XML items, and plain name lists. Rules that
sources differ in (place filter, repeated pages, newest per board, caps, detail enrichment) are
steps that take and return DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.extract import day_number, html_text, level_of, strip_request_prefix, tags, years_by
from ..functions.rules import RULES
from ..functions.text import norm_key, quoted, text
from ..operators.checkpoint import cut
from ..operators.relational import first_per_key, newest_per_group, round_robin

#: Fields of a posting as every adapter gives them.
POSTING = "source string, sid string, title string, company string, city string, url string, level string, years_min int, years_max int, tech array<string>, desc string, active boolean, ord bigint"
_FIELDS = [x.split()[0] for x in POSTING.split(", ")]

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Feed:
    """One source: where its payloads lie, how they are cut, and what each field is."""

    name: str
    path: str
    #: "json", "html", "script", "xml" or "lines"
    kind: str = "json"
    #: json: DDL of a payload; script: DDL of the embedded document; xml: DDL of an item
    schema: str = ""
    #: json/script: expression of the list of items; html: pattern of one card; xml: row tag
    items: str = ""
    #: script: pattern of the opening of the element that holds the document
    opening: str = ""
    #: the document is a JSON string of JSON
    twice: bool = False
    #: posting field -> SQL expression over ``item`` (json, script, xml), or pattern with one group (html)
    fields: dict[str, str] = field(default_factory=dict)
    company: str = ""
    #: texts are HTML
    html_desc: bool = False
    #: reading of years that the source's texts need
    years: str = "first"
    steps: tuple[Step, ...] = ()
    cap: int | None = None
    #: json/lines: expression over the payload ``d`` that gives its place among the payloads; else files count by name
    page: str = ""
    #: a page without any new item is a server's repeat: it and all later pages are left out
    stop_on_repeat: bool = False


def _payloads(spark: SparkSession, feed: Feed) -> DataFrame:
    """``item`` with ``_file``, ``_page`` and ``_pos``, one row for each item of each payload; an empty payload has a null item."""
    if feed.kind == "xml":
        df = spark.read.format("xml").option("rowTag", feed.items).option("mode", "PERMISSIVE").schema(feed.schema).load(feed.path)
        return df.select(F.struct(*df.columns).alias("item"), F.col("_metadata.file_path").alias("_file"), F.lit(None).cast("bigint").alias("_page"), F.monotonically_increasing_id().alias("_pos"))
    raw = spark.read.option("wholetext", feed.kind != "lines").text(feed.path).select("value", F.col("_metadata.file_path").alias("_file"))
    if feed.kind == "lines":
        raw = raw.filter(F.trim("value") != "")
    page = F.lit(None).cast("bigint")
    if feed.kind in ("json", "lines"):
        doc = raw.select("_file", F.from_json("value", feed.schema).alias("d"))
        page = F.expr(feed.page).cast("bigint") if feed.page else page
    elif feed.kind == "script":
        body = F.regexp_extract("value", rf"(?is){feed.opening}\s*(.*?)\s*;?\s*</script>", 1)
        if feed.twice:
            body = F.get_json_object(F.concat(F.lit('{"x":'), body, F.lit("}")), "$.x")
        doc = raw.select("_file", F.from_json(body, feed.schema).alias("d"))
    else:
        cards = F.regexp_extract_all("value", F.lit(feed.items), 0)
        return raw.select("_file", page.alias("_page"), F.posexplode_outer(cards).alias("_pos", "item"))
    listed = F.expr(feed.items) if feed.items else F.array("d")
    return doc.filter("d is not null").select("_file", page.alias("_page"), F.posexplode_outer(listed).alias("_pos", "item"))


def _in_order(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_page`` as the number of the payload and ``ord`` by payload and place in it.

    Payloads that do not number themselves count by the names of their files: the distinct names are
    ranked, never the items.
    """
    files = rows.filter("_page is null").select("_file").distinct().withColumn("_no", F.row_number().over(Window.orderBy("_file")).cast("bigint"))
    numbered = rows.join(files, "_file", "left").withColumn("_page", F.coalesce("_page", "_no")).drop("_no")
    return numbered.withColumn("ord", F.call_function("shiftleft", F.col("_page"), F.lit(34)) + F.coalesce(F.col("_pos").cast("bigint"), F.lit(0).cast("bigint")))


def read_feed(spark: SparkSession, feed: Feed) -> DataFrame:
    """Postings of one feed in the common shape; unreadable payloads give no rows."""
    every = _in_order(_payloads(spark, feed))
    rows = every.filter("item is not null")
    get = (lambda c: F.regexp_extract("item", feed.fields[c], 1)) if feed.kind == "html" else (lambda c: F.expr(feed.fields[c]))
    rows = rows.withColumns({f"f_{c}": get(c) for c in feed.fields})
    has = lambda c: F.col(f"f_{c}") if c in feed.fields else None
    value = lambda c, default="": F.trim(text(has(c).cast("string"))) if c in feed.fields else F.lit(default)
    desc = html_text(value("desc")) if feed.html_desc else value("desc")
    rows = rows.withColumn("_desc", desc).withColumn("_title", strip_request_prefix(value("title")))
    years = years_by("_desc", feed.years)
    level = F.coalesce(F.nullif(F.lower(value("level")), F.lit("")), level_of("_title"))
    board = value("board")
    out = rows.select(
        F.when(board != "", F.concat(F.lit(f"{feed.name}:"), board)).otherwise(feed.name).alias("source"), value("sid").alias("sid"), F.col("_title").alias("title"),
        F.when(value("company") != "", value("company")).otherwise(feed.company).alias("company"), value("city").alias("city"), value("url").alias("url"), level.alias("level"),
        (has("years_min").cast("int") if "years_min" in feed.fields else years["lo"]).alias("years_min"), (has("years_max").cast("int") if "years_max" in feed.fields else years["hi"]).alias("years_max"),
        (has("tech").cast("array<string>") if "tech" in feed.fields else tags("_desc", RULES.vocabulary)).alias("tech"), F.col("_desc").alias("desc"),
        (F.coalesce(has("active").cast("boolean"), F.lit(True)) if "active" in feed.fields else F.lit(True)).alias("active"), *([has("updated").alias("updated")] if "updated" in feed.fields else []), "_page", "ord",
    )
    out = first_per_key(out, F.concat_ws("\u0001", "source", "sid"), [F.col("ord")])
    if feed.stop_on_repeat:
        stop = every.select("_page").distinct().join(out.select("_page").distinct(), "_page", "left_anti").agg(F.min("_page")).first()[0]
        out = out if stop is None else out.filter(F.col("_page") < stop)
    for step in feed.steps:
        out = step(out)
    if feed.cap is not None:
        out = out.orderBy("ord").limit(feed.cap)
    return out.select(*_FIELDS)


# steps


def any_place(*tokens: str, blank_passes: bool = False) -> Step:
    """Rows whose city holds one of the tokens; servers' own filters cannot be trusted."""
    pattern = rf"(?i)(?:{quoted(tokens)})"
    return lambda df: df.filter(F.col("city").rlike(pattern) | ((F.col("city") == "") if blank_passes else F.lit(False)))


def last_country(code: str) -> Step:
    """Rows whose *last* two-letter code is the country (an earlier one may be a state)."""
    return lambda df: df.filter(F.try_element_at(F.filter(F.split("city", r"[,\s]+"), lambda x: x.rlike("^[A-Z]{2}$")), F.lit(-1)) == code)


def title_gate(pattern: str) -> Step:
    return lambda df: df.filter(F.col("title").rlike(rf"(?i){pattern}"))


def only_active(df: DataFrame) -> DataFrame:
    return df.filter("active")


def newest(n: int, uncapped: Iterable[str] = ()) -> Step:
    """The newest ``n`` of each board (needs an ``updated`` field); some boards whole."""
    return lambda df: newest_per_group(df, ["source"], [F.col("updated").desc_nulls_last(), F.col("ord")], n, F.col("source").isin(*uncapped))


def newest_by_day(n: int) -> Step:
    """The newest ``n`` by a date written in words (field ``updated``), unreadable dates last."""
    return lambda df: df.orderBy(day_number("updated").desc(), "ord").limit(n)


def dealt_details(details: DataFrame, lane: Column, per_lane: int, total: int) -> Step:
    """Texts from detail records (sid, desc), read in turns: the first of each lane, then the second, within both budgets."""

    def step(df: DataFrame) -> DataFrame:
        chosen = round_robin(df.select("source", "sid", "ord", lane.alias("_lane")), "_lane", [F.col("ord")], per_lane, total).select("source", "sid")
        full = details.join(chosen.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.max_by("desc", F.length("desc")).alias("_full"))
        picked = df.join(chosen.withColumn("_in", F.lit(True)), ["source", "sid"], "left").join(full, "sid", "left")
        return picked.withColumn("desc", F.when(F.col("_in"), F.coalesce("_full", "desc")).otherwise(F.col("desc"))).drop("_full", "_in")

    return step


def without_titles_of(other: DataFrame) -> Step:
    """Rows whose title the other site does not have."""
    return lambda df: df.withColumn("_nt", norm_key("title")).join(other.select(norm_key("title").alias("_nt")).distinct(), "_nt", "left_anti").drop("_nt")


def best_places(rank: Column, most: int = 3) -> Step:
    """Of several places in ``city`` (split at ``;``) the ``most`` best by ``rank`` of ``place``, joined by slashes; those of rank null leave."""

    def step(df: DataFrame) -> DataFrame:
        each = df.select("source", "sid", F.posexplode(F.split("city", r"\s*;\s*")).alias("_i", "place")).withColumn("_r", rank).filter("_r is not null and place <> ''")
        best = each.groupBy("source", "sid").agg(F.array_sort(F.collect_set(F.struct("_r", "_i", "place"))).alias("_ps")).select("source", "sid", F.array_join(F.transform(F.slice("_ps", 1, most), lambda p: p["place"]), " / ").alias("_city"))
        return df.join(best, ["source", "sid"], "left").withColumn("city", F.coalesce("_city", F.lit(""))).drop("_city")

    return step


def union_first(*feeds: DataFrame) -> DataFrame:
    """Several passes over one source: the first pass that has a posting wins; list order goes by pass."""
    every = reduce(lambda a, b: a.unionByName(b), [f.withColumn("ord", F.call_function("shiftleft", F.lit(i).cast("bigint"), F.lit(58)) + F.col("ord")) for i, f in enumerate(feeds)])
    return first_per_key(every, F.concat_ws("\u0001", "source", "sid"), [F.col("ord")])


def validated(strategies: list[DataFrame], good: Column, least: float = 0.8) -> DataFrame:
    """Rows of the first strategy (a server's filter) of which at least ``least`` are ``good``; else the good rows of the last.

    A filter that a server ignores shows by that share; good rows are then filtered here.
    """
    for df in strategies:
        share = df.agg(F.avg(F.coalesce(good, F.lit(False)).cast("double"))).first()[0]
        if share is not None and share >= least:
            return df.filter(good)
    return strategies[-1].filter(good)


def truncated(n: int) -> Step:
    return lambda df: df.withColumn("desc", F.left("desc", F.lit(n)))


def with_details(details: DataFrame, budget: int, order: list | None = None) -> Step:
    """Longer texts from detail records (sid, desc) for the first ``budget`` rows."""

    def step(df: DataFrame) -> DataFrame:
        chosen = df.orderBy(*(order or ["ord"])).limit(budget).select("sid")
        full = details.join(chosen, "sid", "left_semi").groupBy("sid").agg(F.max_by("desc", F.length("desc")).alias("_full"))
        return df.join(full, "sid", "left").withColumn("desc", F.when(F.length(text("_full")) > F.length("desc"), F.col("_full")).otherwise(F.col("desc"))).drop("_full")

    return step


def relocated(lookup: DataFrame, when: Column) -> Step:
    """Cities from a look-up (sid, city) for the rows that ``when`` selects."""

    def step(df: DataFrame) -> DataFrame:
        return df.join(lookup.select("sid", F.col("city").alias("_city")), "sid", "left").withColumn("city", F.when(when & F.col("_city").isNotNull(), F.col("_city")).otherwise(F.col("city"))).drop("_city")

    return step


# collection

REGISTRY: dict[str, Callable[[SparkSession], DataFrame]] = {}


def register(name: str):
    """Add an adapter under a name."""

    def wrap(f: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession], DataFrame]:
        REGISTRY[name] = f
        return f

    return wrap


def collect(spark: SparkSession, names: Iterable[str], adapters: dict[str, Callable[[SparkSession], DataFrame]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(all postings, yield of each source). A missing adapter is left out, a failing one counts -1."""
    adapters = REGISTRY if adapters is None else adapters
    parts, failed, named = [], [], []
    for n in names:
        if n not in adapters:
            continue
        named.append(n)
        try:
            parts.append(cut(adapters[n](spark)).withColumn("_adapter", F.lit(n)))  # written at once, so errors at run time show here
        except Exception:  # noqa: BLE001 - one source must not stop the run
            failed.append(n)
    empty = spark.createDataFrame([], POSTING + ", _adapter string")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, empty)
    listed = spark.createDataFrame([(n, n in failed) for n in named], "source string, failed boolean")
    counts = rows.groupBy(F.col("_adapter").alias("source")).agg(F.count("*").alias("n"))
    yields = listed.join(counts, "source", "left").select("source", F.when(F.col("failed"), F.lit(-1)).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("n"))
    return rows.drop("_adapter"), yields


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """Names of a text file, one a line, ``#`` opens a comment."""
    return spark.read.text(path).select(F.trim(F.substring_index("value", "#", 1)).alias("name")).filter("name <> ''").distinct()
