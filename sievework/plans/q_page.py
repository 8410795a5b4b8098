"""Queries on curation overlays, the page and its publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import region as G
from ..functions import text as T
from ..functions.rules import RULES as R
from ..operators import classify as C
from ..operators import collapse as CO
from ..operators import overlay as O
from . import sqltext as S
from .base import Registry
from .q_text import region_sql

reg = Registry()
_RANK = "CASE verdict WHEN 'YES' THEN 3 WHEN 'REACH' THEN 2 WHEN 'NO' THEN 1 ELSE 0 END"
_FILLED = "CAST(coalesce(company, '') <> '' AS INTEGER) + CAST(coalesce(role, '') <> '' AS INTEGER)"
_K = S.url_norm("url")


def _entries(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_id").alias("ord"), "url", "verdict", "match", "company", "role", "pull_date")


@reg.add("page_rows", sql=f"""SELECT {_K} AS k, first(verdict ORDER BY {_RANK} DESC, {_FILLED} DESC, row_id) AS verdict, first(match ORDER BY {_RANK} DESC, {_FILLED} DESC, row_id) AS match,
  first(company ORDER BY {_RANK} DESC, {_FILLED} DESC, row_id) AS company, count(*) AS n FROM page_rows WHERE {_K} <> '' GROUP BY 1""")
def q_norm_map(rows: DataFrame) -> DataFrame:
    """One curation entry for each link."""
    return O.norm_map(_entries(rows)).select("k", "verdict", "match", "company", "n")


@reg.add("page_rows", sql=f"""SELECT {_K} AS k, coalesce(arg_min(CASE WHEN coalesce(verdict, '') NOT IN ('', 'New') THEN verdict END, CASE WHEN coalesce(verdict, '') NOT IN ('', 'New') THEN row_id END), arg_max(coalesce(verdict, ''), row_id)) AS v FROM page_rows WHERE {_K} <> '' GROUP BY 1""")
def q_norm_values(rows: DataFrame) -> DataFrame:
    """One value for each link: the first that says something, else the last."""
    return O.norm_values(rows.select(F.col("row_id").alias("ord"), "url", F.col("verdict").alias("v")))


_LAYERS = f"""layer AS (SELECT {_K} AS k, CASE WHEN pull_date < '2026-04-01' THEN 'verdicts' WHEN pull_date < '2026-07-01' THEN 'second' ELSE 'rescued' END AS name, first(verdict ORDER BY {_RANK} DESC, {_FILLED} DESC, row_id) AS verdict,
  first(match ORDER BY {_RANK} DESC, {_FILLED} DESC, row_id) AS match FROM page_rows WHERE {_K} <> '' GROUP BY 1, 2)"""


def _layers(rows: DataFrame) -> list[tuple[str, DataFrame]]:
    e = _entries(rows)
    cut = lambda lo, hi: O.norm_map(e.filter((F.col("pull_date") >= lo) & (F.col("pull_date") < hi)))
    return [("verdicts", cut("", "2026-04-01")), ("second", cut("2026-04-01", "2026-07-01")), ("rescued", cut("2026-07-01", "9"))]


@reg.add("page_rows", sql=f"""WITH {_LAYERS} SELECT p.row_id, coalesce(a.name, b.name, c.name) AS layer, CASE WHEN a.k IS NOT NULL THEN a.verdict WHEN b.k IS NOT NULL THEN b.verdict ELSE c.verdict END AS verdict,
  CASE WHEN a.k IS NOT NULL THEN a.match WHEN b.k IS NOT NULL THEN b.match ELSE c.match END AS match FROM (SELECT row_id, {_K} AS k FROM page_rows) p
  LEFT JOIN layer a ON a.k = p.k AND a.name = 'verdicts' LEFT JOIN layer b ON b.k = p.k AND b.name = 'second' LEFT JOIN layer c ON c.k = p.k AND c.name = 'rescued'""")
def q_overlay_precedence(rows: DataFrame) -> DataFrame:
    """Verdicts of three layers by precedence, each entry taken whole."""
    return O.overlay(rows.select("row_id", "url"), _layers(rows)).select("row_id", "o.layer", "o.verdict", "o.match")


@reg.add("page_rows", sql=f"""WITH {_LAYERS} SELECT k, count(DISTINCT verdict) AS n, string_agg(DISTINCT name || '=' || verdict, ',' ORDER BY name || '=' || verdict) AS votes FROM layer WHERE coalesce(verdict, '') <> '' GROUP BY k HAVING count(DISTINCT verdict) > 1""")
def q_divergent(rows: DataFrame) -> DataFrame:
    """Links on which the layers disagree."""
    return O.divergent(_layers(rows))


@reg.add("page_rows", "accepted_urls", sql=f"""WITH cur AS (SELECT feed_id AS ord, {_K} AS k, CASE feed_id % 4 WHEN 0 THEN 'North' WHEN 1 THEN 'Center' WHEN 2 THEN 'South' ELSE 'Abroad' END AS region, CASE feed_id % 3 WHEN 0 THEN 'NO' WHEN 1 THEN 'YES' ELSE 'REACH' END AS verdict, CASE WHEN feed_id % 10 = 0 THEN 'Sent' ELSE '' END AS status FROM accepted_urls),
have AS (SELECT {_K} AS k FROM page_rows UNION SELECT {S.url_norm('d.url')} FROM (SELECT unnest(dups) AS d FROM page_rows))
SELECT min(ord) AS ord, k FROM cur WHERE k <> '' AND (status = 'Sent' OR (verdict <> 'NO' AND region IN ('North', 'Center', 'Unknown'))) AND k NOT IN (SELECT k FROM have WHERE k IS NOT NULL) GROUP BY k""")
def q_inject_missing(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """Curated links that the page lacks, with tombstones and dropped regions left out."""
    pick = lambda n, *vs: F.element_at(F.array(*map(F.lit, vs)), (F.col("feed_id") % n + 1).cast("int"))
    cur = accepted.select(F.col("feed_id").alias("ord"), "url", pick(4, "North", "Center", "South", "Abroad").alias("region"), pick(3, "NO", "YES", "REACH").alias("verdict"), F.when(F.col("feed_id") % 10 == 0, "Sent").otherwise("").alias("status"))
    return O.inject_missing(rows, cur, ("North", "Center", "Unknown")).select("ord", "k")


@reg.add("page_rows", sql=f"""WITH e AS (SELECT {_K} AS k, max(coalesce(match, 0)) AS note FROM page_rows WHERE important AND {_K} <> '' GROUP BY 1),
x AS (SELECT row_id, 0 AS pos, {_K} AS k FROM page_rows UNION ALL SELECT row_id, i, {S.url_norm('dups[i].url')} FROM (SELECT row_id, dups, unnest(range(1, len(dups) + 1)) AS i FROM page_rows)),
h AS (SELECT row_id, pos, note FROM x JOIN e USING (k) WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY pos) = 1)
SELECT p.row_id, h.note, CAST(h.pos AS INTEGER) AS pos FROM page_rows p LEFT JOIN h USING (row_id)""")
def q_copy_flags(rows: DataFrame) -> DataFrame:
    """Flags found under a row's own link, else under its first copy that has one."""
    e = rows.filter("important").withColumn("k", T.url_norm("url")).filter("k <> ''").groupBy("k").agg(F.max(F.coalesce("match", F.lit(0))).alias("note"))
    return O.array_key_lookup(rows.select("row_id", "url", "dups"), e, "note").select("row_id", "note", F.col("pos").cast("int").alias("pos"))


_RULES = list(R.company_rules)


@reg.add("page_rows", sql="SELECT row_id, CASE " + " ".join(f"WHEN {S.company_is('company', ns)} THEN {S.lit(n)}" for n, ns in _RULES) + " END AS label FROM page_rows")
def q_company_rules(rows: DataFrame) -> DataFrame:
    """The first company rule of each row."""
    return rows.select("row_id", O.first_rule(rows, "company", _RULES).alias("label"))


@reg.add("page_rows", sql=f"""WITH x AS (SELECT row_id, company, {S.title_key('role')} AS t, coalesce(company, '') = '' AS masked FROM page_rows), n AS (SELECT t, min(company) AS named_company FROM x WHERE NOT masked GROUP BY t HAVING count(DISTINCT company) = 1)
SELECT row_id, named_company FROM x JOIN n USING (t) WHERE masked AND len(string_split(t, ' ')) >= 3""")
def q_masked_unique(rows: DataFrame) -> DataFrame:
    """Masked rows whose title only one company has."""
    t = T.title_key("role")
    return O.masked_unique(rows.select("row_id", "company", "role"), t, F.size(F.split(t, " ")) >= 3, T.text("company") == "").select("row_id", "named_company")


@reg.add("page_rows")
def q_collapse_copies(rows: DataFrame) -> DataFrame:
    """Copies of one opening on the page, merged greedily."""
    return CO.collapse_copies(rows).select("key", "row_id", "important", F.array_join(F.col("merged").cast("array<string>"), ",").alias("merged"), F.size("urls").alias("n_urls"))


_OTHERS = f"list_sort([d.url FOR d IN coalesce(dups, []) IF coalesce(d.url, '') <> '' AND NOT {S.is_board('d.url')}])"


@reg.add("page_rows", sql=f"SELECT row_id, CASE WHEN {S.is_board('url')} AND len({_OTHERS}) > 0 THEN ({_OTHERS})[1] ELSE coalesce(url, '') END AS link FROM page_rows")
def q_repick_link(rows: DataFrame) -> DataFrame:
    """The employer's link in place of a board's."""
    return rows.select("row_id", O.repick_link("url", "dups", R.boards).alias("link"))


_MV = "coalesce(match, least(CASE WHEN coalesce(fit, 0) = 0 THEN 50 ELSE fit * 18 END, 65))"


@reg.add("page_rows", sql=f"""SELECT row_id, rank FROM (SELECT row_id, row_number() OVER (ORDER BY coalesce(important, false) DESC, {_MV} DESC, row_id) AS rank FROM page_rows
WHERE ((coalesce(region, 'Unknown') IN ('North', 'Unknown') AND (match IS NULL OR match >= 40) AND CASE WHEN coalesce(verdict, '') = '' THEN 'unrated' ELSE verdict END IN ('YES', 'REACH', 'unrated')) OR coalesce(important, false)) AND contains(lower(coalesce(company, '') || ' ' || coalesce(role, '')), 'engineer')) WHERE rank <= {O.PAGE_ROWS}""")
def q_page_query(rows: DataFrame) -> DataFrame:
    """Filter and order of the page."""
    return O.page_query(rows, q="engineer", regions=("North", "Unknown"), least_match=40, verdicts=("YES", "REACH", "unrated")).select("row_id", F.col("rank").cast("bigint").alias("rank"))


_STATUS = "CASE row_id % 5 WHEN 0 THEN 'Sent' WHEN 1 THEN 'Skip' WHEN 2 THEN 'Interview' WHEN 3 THEN 'New' ELSE '' END"


@reg.add("page_rows", sql=f"""SELECT row_id, rank FROM (SELECT row_id, row_number() OVER (ORDER BY coalesce(important, false) DESC, 2 * CAST(referral AS INTEGER) + CAST(giant AS INTEGER) DESC, row_id) AS rank
FROM (SELECT *, {_STATUS} AS status, {S.company_is('company', R.referral)} AS referral, {S.company_is('company', R.giants)} AS giant, {S.company_is('company', dict(R.company_rules)['broker'])} AS outsourced FROM page_rows)
WHERE ((coalesce(tailor_ready, false) AND NOT outsourced AND verdict = 'YES' AND coalesce(match, 0) < 90) OR coalesce(important, false)) AND status NOT IN ('Sent', 'Interview', 'Skip')) WHERE rank <= {O.PAGE_ROWS}""")
def q_page_flags(rows: DataFrame) -> DataFrame:
    """The page's other conditions: marks, flags, rating below the top, what is done hidden; flagged companies first."""
    status = F.element_at(F.array(*map(F.lit, ("Sent", "Skip", "Interview", "New", ""))), (F.col("row_id") % 5 + 1).cast("int"))
    x = rows.withColumns({"status": status, "referral": T.company_is("company", R.referral), "giant": T.company_is("company", R.giants), "outsourced": T.company_is("company", dict(R.company_rules)["broker"])})
    return O.page_query(x, sort="flags", flags=("tailor_ready",), hide_flags=("outsourced",), top=False, hide_done=True).select("row_id", F.col("rank").cast("bigint").alias("rank"))


@reg.add("page_rows", sql="""SELECT 'date' AS facet, pull_date AS value, count(*) AS n FROM page_rows GROUP BY 2 UNION ALL SELECT 'region', coalesce(nullif(region, ''), 'Unknown'), count(*) FROM page_rows GROUP BY 2
UNION ALL SELECT 'verdict', coalesce(nullif(verdict, ''), 'unrated'), count(*) FROM page_rows GROUP BY 2 UNION ALL SELECT 'fit', coalesce(CAST(fit AS VARCHAR), ''), count(*) FROM page_rows GROUP BY 2
UNION ALL SELECT 'src', split_part(x, ':', 1), count(*) FROM (SELECT unnest(string_split(lower(trim(coalesce(src, ''))), '+')) AS x FROM page_rows) GROUP BY 2""")
def q_facets(rows: DataFrame) -> DataFrame:
    """Facet counts of the page in one pass."""
    full = lambda c, d: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(d))
    pairs = F.array(*(F.struct(F.lit(n).alias("facet"), v.alias("value")) for n, v in (
        ("date", F.col("pull_date")), ("region", full("region", "Unknown")), ("verdict", full("verdict", "unrated")), ("fit", full("fit", "")),
    )))
    families = F.transform(F.split(F.lower(F.trim(T.text("src"))), r"\+"), lambda x: F.struct(F.lit("src").alias("facet"), F.substring_index(x, ":", 1).alias("value")))
    pairs = F.concat(pairs, families)
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


@reg.add("page_rows", sql="SELECT row_id, CASE " + " ".join(f"WHEN verdict = '{v}' AND match IS NOT NULL THEN match BETWEEN {lo} AND {hi}" for v, (lo, hi) in O.BANDS.items()) + " ELSE true END AS band_ok, " + _MV + " AS mval FROM page_rows")
def q_score_band(rows: DataFrame) -> DataFrame:
    """Scores held against the band of their verdict, and estimated matches."""
    return rows.select("row_id", O.band_ok().alias("band_ok"), O.estimated_match().alias("mval"))


@reg.add("page_rows", sql=f"SELECT row_id, CASE WHEN {S.has_word('role', R.skip_words)} THEN '{R.reasons["foundation"]}' WHEN {S.has('role', R.senior)} OR {S.has_word('role', R.senior_words)} THEN 'senior' WHEN {S.has_word('role', R.student_words)} OR {S.has('role', R.student_he)} OR regexp_matches(trim(coalesce(role, '')), {S.lit('^(?:' + T.quoted(R.student_start) + ')')}) THEN 'student' WHEN region IN ('South', 'Jerusalem', 'Abroad') THEN 'region-' || region END AS why FROM page_rows WHERE coalesce(verdict, '') = '' AND NOT coalesce(important, false)")
def q_recheck_rules(rows: DataFrame) -> DataFrame:
    """Unjudged rows tested against today's rules."""
    return rows.filter((T.text("verdict") == "") & ~F.coalesce("important", F.lit(False))).select("row_id", C.rule_failure().alias("why"))


_BANNED = ("merrabria", "mavdumovorn", "orzurel")
_KEEP = ["row_id", "pull_date", "region", "role", "loc", "verdict", "match"]


@reg.add("page_rows", sql=f"SELECT {', '.join(_KEEP)} FROM page_rows WHERE NOT {S.has_word("concat_ws(' ', coalesce(company, ''), coalesce(role, ''), coalesce(loc, ''))", _BANNED)}")
def q_sanitize(rows: DataFrame) -> DataFrame:
    """The whitelisted columns of rows that name nobody on the blocklist."""
    return O.sanitized(rows, _KEEP, _BANNED)


@reg.add("page_rows", "places", sql=f"""SELECT p.row_id, d.region AS derived, CASE WHEN coalesce(p.region, '') IN ('', 'Unknown', 'Center') AND d.region IN ('North', 'South', 'Jerusalem', 'Abroad') THEN d.region ELSE coalesce(p.region, '') END AS region
  FROM page_rows p JOIN ({region_sql("page_rows", "row_id", "loc")}) d USING (row_id)""")
def q_region_repair(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Stored regions replaced by derived ones where they say little."""
    x = G.with_region(rows.select("row_id", "loc", "region"), "loc", places, "derived")
    return x.select("row_id", "derived", G.effective_region("region", "derived").alias("region"))


@reg.add("page_rows", sql=f"""WITH s AS (SELECT {_K} AS k, CASE min(row_id) % 4 WHEN 0 THEN 'Sent' WHEN 1 THEN 'Skip' WHEN 2 THEN 'New' ELSE 'Interview' END AS status FROM page_rows WHERE {_K} <> '' GROUP BY 1),
d AS (SELECT row_id, i, s.status FROM (SELECT row_id, dups, unnest(range(1, len(dups) + 1)) AS i FROM page_rows) JOIN s ON s.k = {S.url_norm('dups[i].url')} WHERE s.status IN ('Sent', 'Interview') QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY i) = 1)
SELECT p.row_id, CASE WHEN coalesce(s.status, 'New') <> 'New' THEN s.status ELSE coalesce(d.status, 'New') END AS status FROM page_rows p LEFT JOIN s ON s.k = {S.url_norm('p.url')} LEFT JOIN d USING (row_id)""")
def q_row_status(rows: DataFrame) -> DataFrame:
    """A row's own mark, else the first copy's that was sent or interviewed."""
    pick = F.element_at(F.array(*map(F.lit, ("Sent", "Skip", "New", "Interview"))), (F.min("row_id") % 4 + 1).cast("int"))
    marks = rows.withColumn("k", T.url_norm("url")).filter("k <> ''").groupBy("k").agg(pick.alias("status"))
    copies = rows.select("row_id", F.posexplode("dups").alias("i", "d")).select("row_id", "i", T.url_norm("d.url").alias("k"))
    inherited = copies.join(marks.filter("status in ('Sent', 'Interview')"), "k").groupBy("row_id").agg(F.min_by("status", "i").alias("copy_status"))
    own = rows.select("row_id", T.url_norm("url").alias("k")).join(marks, "k", "left").join(inherited, "row_id", "left")
    return own.select("row_id", F.when(F.coalesce("status", F.lit("New")) != "New", F.col("status")).otherwise(F.coalesce("copy_status", F.lit("New"))).alias("status"))
