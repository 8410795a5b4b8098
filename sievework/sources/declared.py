"""Declared feeds: one for each family of payloads, with the rules that family needs.

A declaration names where payloads lie, how they are cut and which steps follow; employers and
addresses are parameters of a run. ``land`` writes payloads of such shapes from a table of
postings, so that the whole way from payload to posting can be tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text
from . import feeds as S

#: Items of one payload.
PAGE = 64
_JOB = "struct<id:string,title:string,firm:string,place:string,link:string,board:string,text:string,updated:string,live:boolean>"
_JSON = {"sid": "item.id", "title": "item.title", "company": "item.firm", "city": "item.place", "url": "item.link", "desc": "item.text", "updated": "item.updated", "active": "item.live"}


def boards(path: str, name: str, tokens: tuple[str, ...], most: int, uncapped: tuple[str, ...] = ()) -> S.Feed:
    """Boards of many employers in JSON pages: place filter, then the newest of each board, some boards whole."""
    return S.Feed(name, path, kind="lines", schema=f"page bigint, jobs array<{_JOB}>", items="d.jobs", page="d.page", fields=_JSON | {"board": "item.board"}, steps=(S.only_active, S.any_place(*tokens, blank_passes=True), S.newest(most, uncapped)))


def listing(path: str, name: str, steps: tuple[S.Step, ...] = (), stop_on_repeat: bool = False) -> S.Feed:
    """One site's listing in JSON pages with a cursor."""
    return S.Feed(name, path, kind="lines", schema=f"page bigint, jobs array<{_JOB}>", items="d.jobs", page="d.page", fields=_JSON, steps=steps, stop_on_repeat=stop_on_repeat)


def cards(path: str, name: str, cap: int | None = None) -> S.Feed:
    """HTML pages of cards."""
    return S.Feed(name, path, kind="html", items=r'(?s)<article data-id=.*?</article>', fields={"sid": r'data-id="([^"]*)"', "title": r"(?s)<h3>(.*?)</h3>", "city": r"(?s)<i>(.*?)</i>"}, cap=cap)


def state_script(path: str, name: str) -> S.Feed:
    """Pages that carry their data as JSON of JSON in a script element."""
    return S.Feed(name, path, kind="script", opening='<script id="state">', twice=True, schema=f"jobs array<{_JOB}>", items="d.jobs", fields=_JSON)


def rss(path: str, name: str, pattern: str) -> S.Feed:
    """XML items, titles that match only."""
    return S.Feed(name, path, kind="xml", items="item", schema="guid string, title string, link string", fields={"sid": "item.guid", "title": "item.title", "url": "item.link"}, steps=(S.title_gate(pattern),))


def _pages(postings: DataFrame) -> DataFrame:
    job = F.struct(
        "ord", text("sid").alias("id"), text("title").alias("title"), text("company").alias("firm"), text("city").alias("place"), text("url").alias("link"), F.regexp_extract(text("source"), ":(.+)$", 1).alias("board"), text("desc").alias("text"),
        F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated"), F.coalesce("active", F.lit(True)).alias("live"),
    )
    # a page holds at most PAGE neighbouring postings
    return postings.groupBy(F.floor(F.col("ord") / PAGE).alias("page")).agg(F.array_sort(F.collect_list(job)).alias("jobs"))


def land(postings: DataFrame, path: str, kind: str = "json") -> str:
    """Write ``postings`` as payloads of a kind ("json": a page a line, "html", "script", "xml"); the folder."""
    pages = _pages(postings)
    clean: Column
    if kind == "json":
        pages.select(F.to_json(F.struct("page", "jobs")).alias("value")).write.text(path)
        return path
    named = F.format_string("page_%012d", F.col("page")).alias("name")  # files are read by name
    clean = lambda c: F.regexp_replace(F.translate(c, "<>&", "   "), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    if kind == "html":
        body = F.array_join(F.transform("jobs", lambda j: F.concat(F.lit('<article data-id="'), j["id"], F.lit('"><h3>'), clean(j["title"]), F.lit("</h3><i>"), clean(j["place"]), F.lit("</i></article>"))), "\n")
    elif kind == "script":
        # the inner JSON is a string of the outer one; a closing tag inside would end the element
        inner = F.to_json(F.struct("jobs"))
        body = F.concat(F.lit('<html><script id="state">'), F.replace(F.regexp_extract(F.to_json(F.struct(inner.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit("</"), F.lit("<\\/")), F.lit("</script></html>"))
    else:
        item = F.transform("jobs", lambda j: F.concat(F.lit("<item><guid>"), clean(j["id"]), F.lit("</guid><title>"), clean(j["title"]), F.lit("</title><link>"), clean(j["link"]), F.lit("</link></item>")))
        body = F.concat(F.lit("<rss>"), F.array_join(item, ""), F.lit("</rss>"))
    # one folder a page keeps a page in a file of its own
    pages.select(named, F.regexp_replace(body, r"[\r\n]+", " ").alias("value")).repartition("name").write.partitionBy("name").text(path)
    return path
