"""Queries on texts: classification, extraction, identity keys, truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import region as G
from ..functions import text as T
from ..functions.rules import RULES as R
from ..operators import classify as C
from . import sqltext as S
from .base import Registry

reg = Registry()


def classified(postings: DataFrame) -> DataFrame:
    return C.classify(C.facts(C.normalize(postings)))


@reg.add("postings", sql="WITH " + S.FACTS + "SELECT coalesce(source, '') AS source, coalesce(lane, 'gate-miss') AS lane, count(*) AS n FROM fitted GROUP BY 1, 2")
def q_pipeline_lanes(postings: DataFrame) -> DataFrame:
    """Postings of each source by lane."""
    return classified(postings).groupBy("source", F.coalesce("lane", F.lit("gate-miss")).alias("lane")).agg(F.count("*").alias("n"))


@reg.add("postings", sql="""SELECT ord, coalesce(source, '') AS source, coalesce(sid, '') AS sid, coalesce(title, '') AS title, coalesce(company, '') AS company, coalesce(city, '') AS city, coalesce(url, '') AS url,
  lower(coalesce(level, '')) AS level, years_min, coalesce(active, true) AS active, array_to_string(coalesce(tech, []), ',') AS tech FROM postings""")
def q_normalize(postings: DataFrame) -> DataFrame:
    """The fixed posting schema."""
    return C.normalize(postings).select("ord", "source", "sid", "title", "company", "city", "url", "level", "years_min", "active", F.array_join("tech", ",").alias("tech"))


@reg.add("postings", sql="WITH " + S.FACTS + "SELECT ord, gate, senior_title, student, gap, qa, foundation, experienced, manual, industrial, bench, training, giant, referral, signals FROM fitted")
def q_title_gate(postings: DataFrame) -> DataFrame:
    """Every title and company predicate."""
    return C.facts(C.normalize(postings)).select("ord", "gate", "senior_title", "student", "gap", "qa", "foundation", "experienced", "manual", "industrial", "bench", "training", "giant", "referral", "signals")


@reg.add("postings", sql="WITH " + S.FACTS + "SELECT ord, lane, why, fit, tailor FROM fitted")
def q_classify(postings: DataFrame) -> DataFrame:
    """Lane, reason, fit and tailoring of each posting."""
    return classified(postings).select("ord", "lane", "why", "fit", "tailor")


@reg.add("postings", sql="WITH " + S.FACTS + "," + S.ROUTES + "SELECT ord, bucket, reason FROM routes")
def q_route_buckets(postings: DataFrame) -> DataFrame:
    """Every bucket each posting goes to."""
    return C.bucket_rows(C.routed(classified(postings))).select("ord", "bucket", "reason")


@reg.add("postings", sql="WITH " + S.FACTS + f"SELECT ord, lane, region FROM fitted WHERE {S.ON_PAGE}")
def q_page_gate(postings: DataFrame) -> DataFrame:
    """Rows that stay on the page."""
    return C.only(C.routed(classified(postings)), "on_page").select("ord", "lane", "region")


@reg.add("postings", sql=f"SELECT p.ord, y.ymin FROM postings p LEFT JOIN ({S.YEARS}) y USING (ord)")
def q_parse_years(postings: DataFrame) -> DataFrame:
    """Years each text requires."""
    return postings.select("ord", X.parse_years("desc").alias("ymin"))


_EVERY = f"list_filter([CAST(floor(CAST(x AS DOUBLE)) AS INTEGER) FOR x IN regexp_extract_all({S.flat('\"desc\"')}, {S.lit(X.SINGLE)}, 2)], lambda n: n <= 25)"


@reg.add("postings", sql=f"SELECT ord, list_min({_EVERY}) AS y_min, ({_EVERY})[1] AS y_first, list_min({_EVERY}) AS y_lo, CASE WHEN len({_EVERY}) > 1 THEN list_max({_EVERY}) END AS y_hi FROM postings")
def q_years_strategies(postings: DataFrame) -> DataFrame:
    """Other readings of years: smallest, first, smallest and largest."""
    both = X.years_by("desc", "minmax")
    return postings.select("ord", X.years_by("desc", "min")["lo"].alias("y_min"), X.years_by("desc", "first")["lo"].alias("y_first"), both["lo"].alias("y_lo"), both["hi"].alias("y_hi"))


_LEVEL = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(title, '')), {S.lit(p)}) THEN {S.lit(n)}" for n, p in X.LEVELS) + " ELSE '' END"


@reg.add("postings", sql=f"SELECT ord, {_LEVEL} AS level FROM postings")
def q_level(postings: DataFrame) -> DataFrame:
    """Level by the title's decision list."""
    return postings.select("ord", X.level_of("title").alias("level"))


_TAGS = ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(\"desc\", '')), {S.lit('(^|[^a-z0-9])' + T.quoted([w]) + '($|[^a-z0-9+#])')}) THEN {S.lit(w)} END" for w in R.vocabulary)


@reg.add("postings", sql=f"SELECT ord, array_to_string(list_slice(list_filter([{_TAGS}], lambda x: x IS NOT NULL), 1, 12), ',') AS tags FROM postings")
def q_tech_tags(postings: DataFrame) -> DataFrame:
    """Tags in vocabulary order."""
    return postings.select("ord", F.array_join(X.tags("desc", R.vocabulary), ",").alias("tags"))


_CATS = [(k, S.count_words('"desc"', ws)) for k, ws in R.categories]
_BEST = f"greatest({', '.join(c for _, c in _CATS)})"


@reg.add("postings", sql=f"SELECT ord, CASE WHEN {_BEST} < 2 THEN 'general' " + " ".join(f"WHEN {c} = {_BEST} THEN {S.lit(k)}" for k, c in _CATS) + " END AS category FROM postings")
def q_keyword_score(postings: DataFrame) -> DataFrame:
    """Best category of each text."""
    return postings.select("ord", X.best_category("desc", R.categories).alias("category"))


@reg.add("postings", sql=f"""SELECT ord, {S.norm_key('title')} AS norm_title, {S.title_key('title')} AS title_key, {S.fingerprint('"desc"')} AS fp, {S.soft_key()} AS soft,
  CASE WHEN {S.norm_key('company')} <> '' THEN {S.norm_key('company')} || '|' || {S.norm_key('title')} END AS legacy FROM postings""")
def q_identity_keys(postings: DataFrame) -> DataFrame:
    """Identity keys of each posting."""
    keys = T.repost_keys("company", "title", "region", "city", "desc")
    return postings.select("ord", T.norm_key("title").alias("norm_title"), T.title_key("title").alias("title_key"), T.fingerprint("desc").alias("fp"), keys.alias("k")).select("ord", "norm_title", "title_key", "fp", "k.soft", "k.legacy")


def region_sql(table: str, key: str, loc: str) -> str:
    """``key, region`` of each row, by brute force: every fragment against every place name."""
    fold = lambda x: f"translate(lower({x}), '’׳`´', chr(39) || chr(39) || chr(39) || chr(39))"
    words = lambda x: f"array_to_string(list_filter(string_split_regex({x}, '{G.GAP.replace(chr(39), chr(39) * 2)}'), lambda w: w <> ''), ' ')"
    generic, ways = (", ".join(map(S.lit, x)) for x in (R.generic_places, R.ways_of_working))
    bare = f"array_to_string(list_filter(string_split_regex(regexp_replace(part, '\\([^)]*\\)', ' ', 'g'), '{G.GAP.replace(chr(39), chr(39) * 2)}'), lambda w: w <> '' AND w NOT IN ({ways})), ' ')"
    ranks = " ".join(f"WHEN {S.lit(n)} THEN {i}" for i, n in enumerate(G.RANKED))
    return f"""
WITH names AS (SELECT CASE region {ranks} END AS k, {words(fold("n"))} AS n FROM (SELECT region, unnest([name_en, name_he]) AS n FROM places) WHERE region IN ({", ".join(map(S.lit, G.RANKED))}) AND {words(fold("coalesce(n, '')"))} <> ''),
loc AS (SELECT DISTINCT {loc} AS loc FROM {table} WHERE {loc} IS NOT NULL),
parts AS (SELECT loc, part, {words("part")} AS ws, {bare} AS bare FROM (SELECT loc, unnest(string_split_regex({fold("loc")}, {S.lit(G.SEPARATOR)})) AS part FROM loc)),
told AS (SELECT DISTINCT loc, ws FROM parts WHERE ws <> '' AND bare <> '' AND bare NOT IN ({generic}) AND NOT regexp_matches(bare, '^\\d+ (?:more )?locations?$')),
hit AS (SELECT loc, ws, coalesce(min(k), {G.CENTER}) AS k FROM told LEFT JOIN names ON regexp_matches(' ' || ws || ' ', ' ' || CASE WHEN regexp_matches(n, '^[א-ת]') THEN '[{G.PREFIXES}]{{0,2}}' ELSE '' END || n || ' ') GROUP BY ALL),
s AS (SELECT loc, list(DISTINCT k) AS ks FROM hit GROUP BY loc),
r AS (SELECT loc, CASE WHEN ks IS NULL THEN 'Unknown' WHEN list_contains(ks, 0) THEN 'North' WHEN list_contains(ks, 4) THEN 'Center'
  WHEN ks = [3] THEN CASE WHEN regexp_matches(lower(loc), 'israel|ישראל') THEN 'Unknown' ELSE 'Abroad' END WHEN list_contains(ks, 1) THEN 'South' ELSE 'Jerusalem' END AS region FROM loc LEFT JOIN s USING (loc))
SELECT t.{key}, coalesce(r.region, 'Unknown') AS region FROM {table} t LEFT JOIN r ON t.{loc} = r.loc"""


@reg.add("postings", "places", sql=region_sql("postings", "ord", "city"))
def q_region_of(postings: DataFrame, places: DataFrame) -> DataFrame:
    """Region of each posting's city."""
    return G.with_region(postings.select("ord", "city"), "city", places).select("ord", "region")


@reg.add("page_rows", sql=f"SELECT row_id, {S.url_norm('url')} AS u, {S.host('url')} AS host, {S.is_board('url')} AS board, {S.title_key('role')} AS title_key, CASE WHEN coalesce(region, '') = '' THEN 'Unknown' ELSE region END AS region FROM page_rows")
def q_url_identity(rows: DataFrame) -> DataFrame:
    """Link identity of page rows."""
    return rows.select("row_id", T.url_norm("url").alias("u"), T.host("url").alias("host"), T.is_board("url", R.boards).alias("board"), T.title_key("role").alias("title_key"), F.when(T.text("region") == "", "Unknown").otherwise(F.col("region")).alias("region"))


_LBL = f"list_filter(string_split({S.host('url')}, '.'), lambda x: x NOT IN ('www', 'jobs', 'careers', 'boards', 'apply', 'example', 'test', 'com', 'org', 'net', 'io', 'co', 'il', ''))"


_CAPS = f"array_to_string([upper(left(w, 1)) || substr(w, 2) FOR w IN string_split(replace(({_LBL})[1], '-', ' '), ' ')], ' ')"


@reg.add("page_rows", sql=f"SELECT row_id, CASE WHEN {S.is_board('url')} OR len({_LBL}) = 0 THEN '' ELSE {_CAPS} END AS company FROM page_rows")
def q_company_host(rows: DataFrame) -> DataFrame:
    """A company's name from the host of a link."""
    return rows.select("row_id", T.company_from_host("url", boards=R.boards).alias("company"))


@reg.add("documents", sql="""SELECT doc_id, CASE WHEN length(coalesce(text, '')) <= 300 THEN coalesce(text, '') WHEN strpos(reverse(left(text, 300)), ' ') > 0 AND 300 - strpos(reverse(left(text, 300)), ' ') > 0 AND 300 - strpos(reverse(left(text, 300)), ' ') >= 100
  THEN left(text, 300 - strpos(reverse(left(text, 300)), ' ')) ELSE left(text, 300) END AS word_cut, left(coalesce(text, ''), 700) AS blind,
  CASE WHEN length(coalesce(text, '')) <= 400 THEN coalesce(text, '') WHEN strpos(lower(text), 'requirements') <= 200 THEN left(text, 400)
  ELSE left(text, 400 - length(substr(text, strpos(lower(text), 'requirements'), 200)) - 3) || ' … ' || substr(text, strpos(lower(text), 'requirements'), 200) END AS head_tail FROM documents""")
def q_truncate(docs: DataFrame) -> DataFrame:
    """Blind, word-wise and head-and-tail truncation."""
    return docs.select("doc_id", X.word_cut("text", 300).alias("word_cut"), F.left(T.text("text"), F.lit(700)).alias("blind"), X.head_and_tail("text", 400, "requirements").alias("head_tail"))


@reg.add("documents", sql="""SELECT doc_id, CASE WHEN list_min(list_filter([strpos(lower(coalesce(text, '')), 'back to list'), strpos(lower(coalesce(text, '')), '©')], lambda x: x > 0)) IS NULL THEN coalesce(text, '')
  ELSE trim(left(text, list_min(list_filter([strpos(lower(text), 'back to list'), strpos(lower(text), '©')], lambda x: x > 0)) - 1)) END AS body FROM documents""")
def q_section_cut(docs: DataFrame) -> DataFrame:
    """Text before the first boilerplate marker."""
    return docs.select("doc_id", X.cut_at_markers("text", ("back to list", "©")).alias("body"))


@reg.add("documents")
def q_fit_sections(docs: DataFrame) -> DataFrame:
    """Fair shares of 500 characters among the paragraphs of a text."""
    lengths = F.transform(F.filter(F.split(T.text("text"), "\n"), lambda x: x != ""), lambda x: F.length(x))
    shares = X.fair_shares(lengths, 500)
    return docs.select("doc_id", F.array_join(shares.cast("array<string>"), ",").alias("shares"), F.aggregate(shares, F.lit(0), lambda a, x: a + x).alias("granted"))


_HTML = "'<div><h2>' || replace(replace(coalesce(title, ''), '<', ''), '&', '&amp;') || '</h2><script>var x = \"</p>\";</script><!-- note --><ul><li>' || replace(replace(replace(coalesce(\"desc\", ''), '&', '&amp;'), '<', '&lt;'), chr(10), '</li><li>') || '</li></ul></div>'"


def _sql_unescape(x: str) -> str:
    for entity, char in (*X.ENTITIES, ("&amp;", "&")):
        x = f"replace({x}, {S.lit(entity)}, {S.lit(char)})"
    return x


_STRIPPED = f"trim(regexp_replace({_sql_unescape(f"regexp_replace({_HTML}, '<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g'))"


@reg.add("postings", sql=f"SELECT ord, length({_HTML}) AS n_html, {_STRIPPED} AS plain FROM postings")
def q_html_text(postings: DataFrame) -> DataFrame:
    """Tag stripping of pages built from the postings."""
    esc = F.replace(F.replace(F.replace(T.text("desc"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("</li><li>"))
    page = F.concat(F.lit("<div><h2>"), F.replace(F.replace(T.text("title"), F.lit("<"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('</h2><script>var x = "</p>";</script><!-- note --><ul><li>'), esc, F.lit("</li></ul></div>"))
    return postings.select("ord", F.length(page).alias("n_html"), X.strip_tags(page).alias("plain"))


@reg.add("postings")
def q_html_lines(postings: DataFrame) -> DataFrame:
    """Running text of pages: scripts out, list items as lines; and the title from embedded JSON."""
    page = F.concat(
        F.lit("<div><script>var x = '</p>';</script><!-- note --><h2>"), T.text("title"), F.lit("</h2><ul><li>"), F.replace(T.text("desc"), F.lit("\n"), F.lit("</li><li>")), F.lit('</li></ul><script type="application/ld+json">'),
        F.to_json(F.struct(F.lit("JobPosting").alias("@type"), "title", "sid")), F.lit("</script></div>"),
    )
    ld = X.script_json(page, r'<script type="application/ld\+json">', "title string, sid string")
    return postings.select("ord", F.size(F.split(X.html_text(page), "\n")).alias("n_lines"), ld["title"].alias("title"), ld["sid"].alias("sid"))


@reg.add("page_rows", sql="""SELECT row_id, CASE WHEN regexp_matches(trim(regexp_replace(coalesce(loc, ''), '\\s+', ' ', 'g')), '[₪$€]|\\d{2},\\d{3}') THEN '' WHEN contains(coalesce(loc, ''), chr(9)) THEN trim(regexp_extract(loc, '\\t\\s*([A-Za-z][A-Za-z'' -]+)', 1))
  ELSE trim(regexp_replace(coalesce(loc, ''), '\\s+', ' ', 'g')) END AS loc, regexp_replace(regexp_replace(lower(coalesce(role, '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, strftime(pulled_at, '%-d %b %Y') AS day_text, CAST(strftime(pulled_at, '%Y%m%d') AS INTEGER) AS day_no FROM page_rows""")
def q_small_parsers(rows: DataFrame) -> DataFrame:
    """Locations tidied, slugs, and dates read from text."""
    day = F.date_format("pulled_at", "d MMM yyyy")
    return rows.select("row_id", X.tidy_location("loc").alias("loc"), X.slug("role").alias("slug"), day.alias("day_text"), X.day_number(day).alias("day_no"))


@reg.add("documents", sql="SELECT doc_id, trim(regexp_extract(coalesce(text, ''), '(?i)E-mail:\\s*([^|\\n]+)', 1)) AS mail, regexp_extract(coalesce(text, ''), '(\\d{4,})', 1) AS first_id FROM documents")
def q_labelled_fields(docs: DataFrame) -> DataFrame:
    """Labelled fields and ids in a text."""
    return docs.select("doc_id", F.trim(F.regexp_extract(T.text("text"), r"(?i)E-mail:\s*([^|\n]+)", 1)).alias("mail"), F.regexp_extract(T.text("text"), r"(\d{4,})", 1).alias("first_id"))
