"""Queries on the way from landed payloads to postings: each lands its payloads and reads them by a declared feed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import RULES as R
from ..operators.checkpoint import shared_folder
from ..sources import declared as D
from ..sources import feeds as S
from . import sqltext as Q
from .base import Registry

reg = Registry()
TOKENS = ("kfar", "neve", "ramat", "nahal", "israel")


def _landed(postings: DataFrame, kind: str = "json") -> str:
    return D.land(postings, f"{shared_folder(postings.sparkSession)}/landed_{uuid.uuid4().hex}", kind)


_ONE = "SELECT * FROM postings WHERE {} QUALIFY row_number() OVER (PARTITION BY coalesce(source, ''), coalesce(sid, '') ORDER BY ord) = 1"


@reg.add("postings", sql=f"""WITH one AS ({_ONE.format("source LIKE 'stackhire:%' AND coalesce(sid, '') <> ''")}),
here AS (SELECT * FROM one WHERE coalesce(active, true) AND (trim(coalesce(city, '')) = '' OR regexp_matches(lower(city), '{"|".join(TOKENS)}')))
SELECT source, sid, trim(coalesce(company, '')) AS company, trim(coalesce(city, '')) AS city FROM here QUALIFY row_number() OVER (PARTITION BY source ORDER BY fetched_at DESC, ord) <= 25 OR source = 'stackhire:merrabria'""")
def q_feed_boards(postings: DataFrame) -> DataFrame:
    """Boards of many employers: live rows of a place, the newest of each board, one board whole."""
    own = postings.filter("source like 'stackhire:%' and coalesce(sid, '') <> ''")
    feed = D.boards(_landed(own), "stackhire", TOKENS, 25, ("stackhire:merrabria",))
    return S.read_feed(postings.sparkSession, feed).select("source", "sid", "company", "city")


@reg.add("postings", sql=f"""WITH one AS ({_ONE.format("source = 'worklist' AND coalesce(sid, '') <> ''")} ORDER BY ord LIMIT 120)
SELECT sid, trim(regexp_replace(translate(coalesce(city, ''), '<>&', '   '), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\r\\n]+', ' ', 'g')) AS city FROM one""")
def q_feed_cards(postings: DataFrame) -> DataFrame:
    """Cards of HTML pages, capped by list order."""
    feed = D.cards(_landed(postings.filter("source = 'worklist' and coalesce(sid, '') <> ''"), "html") + "/*", "worklist", cap=120)
    return S.read_feed(postings.sparkSession, feed).select("sid", "city")


@reg.add("postings", sql=f"""WITH one AS ({_ONE.format("source = 'tafkidim' AND coalesce(sid, '') <> ''")}) SELECT sid, length(trim(coalesce("desc", ''))) AS n_desc, coalesce(active, true) AS active FROM one""")
def q_feed_script(postings: DataFrame) -> DataFrame:
    """Postings from JSON of JSON inside a page."""
    feed = D.state_script(_landed(postings.filter("source = 'tafkidim' and coalesce(sid, '') <> ''"), "script") + "/*", "tafkidim")
    return S.read_feed(postings.sparkSession, feed).select("sid", F.length("desc").alias("n_desc"), "active")


@reg.add("postings", sql=f"""WITH one AS ({_ONE.format("source = 'roleboard' AND coalesce(sid, '') <> ''")}) SELECT sid FROM one WHERE regexp_matches(lower(coalesce(title, '')), 'engineer|developer')""")
def q_feed_rss(postings: DataFrame) -> DataFrame:
    """XML items with a title of the trade."""
    feed = D.rss(_landed(postings.filter("source = 'roleboard' and coalesce(sid, '') <> ''"), "xml") + "/*", "roleboard", "engineer|developer")
    return S.read_feed(postings.sparkSession, feed).select("sid")


@reg.add("postings", sql=f"""WITH one AS ({_ONE.format("source = 'hirevane' AND coalesce(sid, '') <> ''")}),
lane AS (SELECT *, CASE WHEN regexp_matches(lower(coalesce(title, '')), 'senior') THEN 'a' WHEN regexp_matches(lower(coalesce(title, '')), 'junior') THEN 'b' ELSE 'c' END AS lane FROM one),
rn AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY ord) AS rn FROM lane), turn AS (SELECT *, row_number() OVER (ORDER BY rn, lane) AS turn FROM rn WHERE rn <= 15)
SELECT l.sid, coalesce(t.turn <= 40, false) AS has_text FROM lane l LEFT JOIN turn t ON l.ord = t.ord""")
def q_feed_lanes(postings: DataFrame) -> DataFrame:
    """Texts read in turns over lanes of a listing, within a budget for each lane and for all."""
    own = postings.filter("source = 'hirevane' and coalesce(sid, '') <> ''")
    details = own.select("sid", F.concat(F.lit("text: "), T.text("desc")).alias("desc"))
    low = F.lower("title")
    lane = F.when(low.contains("senior"), "a").when(low.contains("junior"), "b").otherwise("c")
    feed = D.listing(_landed(own.withColumn("desc", F.lit(""))), "hirevane", (S.dealt_details(details, lane, 15, 40),))
    return S.read_feed(postings.sparkSession, feed).select("sid", (F.col("desc") != "").alias("has_text"))


@reg.add("postings", sql=f"""WITH a AS ({_ONE.format("source = 'jobmarrow' AND coalesce(sid, '') <> '' AND ord % 3 = 0")}), b AS ({_ONE.format("source = 'jobmarrow' AND coalesce(sid, '') <> ''")})
SELECT sid, 'first' AS pass FROM a UNION ALL SELECT sid, 'second' FROM b WHERE sid NOT IN (SELECT sid FROM a)""")
def q_feed_passes(postings: DataFrame) -> DataFrame:
    """Two passes over one source by different facets; the first that has a posting wins."""
    spark, own = postings.sparkSession, postings.filter("source = 'jobmarrow' and coalesce(sid, '') <> ''")
    one = S.read_feed(spark, D.listing(_landed(own.filter("ord % 3 = 0")), "jobmarrow"))
    two = S.read_feed(spark, D.listing(_landed(own), "jobmarrow"))
    return S.union_first(one, two).select("sid", F.when(F.col("ord") < 1 << 58, "first").otherwise("second").alias("pass"))


_HERE = f"regexp_matches(lower(coalesce(city, '')), '{'|'.join(TOKENS)}')"


@reg.add("postings", sql=f"SELECT sid FROM ({_ONE.format("source = 'deskfinder' AND coalesce(sid, '') <> ''")}) WHERE {_HERE}")
def q_feed_fallback(postings: DataFrame) -> DataFrame:
    """A server's filter that was ignored (too few rows are in place): filtered here instead."""
    spark, own = postings.sparkSession, postings.filter("source = 'deskfinder' and coalesce(sid, '') <> ''")
    asked = S.read_feed(spark, D.listing(_landed(own), "deskfinder"))
    return S.validated([asked, asked], F.lower("city").rlike("|".join(TOKENS))).select("sid")


@reg.add("postings", sql=f"""WITH a AS ({_ONE.format("source = 'hirevane' AND coalesce(sid, '') <> ''")}), b AS ({_ONE.format("source = 'worklist' AND coalesce(sid, '') <> ''")})
SELECT sid FROM a WHERE {Q.norm_key("trim(regexp_replace(coalesce(title, ''), '^[0-9]{3,} *[-–] *', ''))")} NOT IN (SELECT {Q.norm_key("trim(regexp_replace(coalesce(title, ''), '^[0-9]{3,} *[-–] *', ''))")} FROM b)""")
def q_feed_new_titles(postings: DataFrame) -> DataFrame:
    """Rows of one site whose title another site does not have."""
    spark, own = postings.sparkSession, lambda s: postings.filter((F.col("source") == s) & (F.coalesce("sid", F.lit("")) != ""))
    other = S.read_feed(spark, D.listing(_landed(own("worklist")), "worklist"))
    return S.read_feed(spark, D.listing(_landed(own("hirevane")), "hirevane", (S.without_titles_of(other),))).select("sid")


@reg.add("postings", sql=f"""WITH one AS ({_ONE.format("source LIKE 'orbitats:%' AND coalesce(sid, '') <> ''")}) SELECT source, sid FROM one ORDER BY CAST(strftime(fetched_at, '%Y%m%d') AS INTEGER) DESC, ord LIMIT 120""")
def q_feed_days(postings: DataFrame) -> DataFrame:
    """The newest rows by a date in words."""
    own = postings.filter("source like 'orbitats:%' and coalesce(sid, '') <> ''")
    spark = postings.sparkSession
    days = F.date_format("fetched_at", "d MMM yyyy")
    feed = D.boards(_landed(own), "orbitats", TOKENS, 1)
    from dataclasses import replace

    dated = own.select("source", "sid", "ord", days.alias("day")).groupBy("source", "sid").agg(F.min_by("day", "ord").alias("updated"))
    worded = lambda df: df.drop("updated").join(dated, ["source", "sid"])
    return S.read_feed(spark, replace(feed, steps=(worded, S.newest_by_day(120)))).select("source", "sid")


@reg.add("postings", sql=f"""WITH n AS (SELECT coalesce(source, '') AS source, count(DISTINCT sid) AS n FROM postings WHERE source IN ('hirevane', 'worklist') AND coalesce(sid, '') <> '' GROUP BY 1)
SELECT source, n FROM n UNION ALL SELECT 'broken', -1""")
def q_feed_yields(postings: DataFrame) -> DataFrame:
    """Yield of each source of a run; a source that fails while it is read counts -1 and costs the others nothing."""
    read = lambda s: lambda spark: S.read_feed(spark, D.listing(_landed(postings.filter((F.col("source") == s) & (F.coalesce("sid", F.lit("")) != ""))), s))
    fail = lambda spark: read("hirevane")(spark).withColumn("title", F.raise_error(F.lit("unreadable")).cast("string"))
    adapters = {"hirevane": read("hirevane"), "worklist": read("worklist"), "broken": fail}
    return S.collect(postings.sparkSession, ["hirevane", "broken", "worklist", "absent"], adapters)[1]
