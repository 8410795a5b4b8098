"""Queries on order-aware relational operators, buckets and state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import RULES as R
from ..operators import buckets as B
from ..operators import classify as C
from ..operators import relational as Q
from ..operators import state as ST
from ..operators.checkpoint import cut
from . import sqltext as S
from .base import Registry

reg = Registry()
AS_OF = "2026-06-30"

_MERGED = f"""
k AS (SELECT *, CASE WHEN {S.norm_key('company')} <> '' THEN 'n|' || {S.norm_key('company')} || '|' || left({S.norm_key('title')}, 40) || '|' || coalesce(region, '') ELSE 'm|' || coalesce(source, '') || '|' || coalesce(sid, '') END AS kk FROM postings),
once AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY kk, coalesce(source, ''), coalesce(sid, '') ORDER BY ord) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY kk, source ORDER BY ord) AS rr FROM once),
merged AS (SELECT min(ord) AS ord, count(*) AS n_members, string_agg(DISTINCT coalesce(source, ''), '+' ORDER BY coalesce(source, '')) AS sources, list(ord ORDER BY ord) AS member_ords, string_agg(coalesce(source, '') || ':' || coalesce(sid, ''), ',' ORDER BY ord) AS members FROM r GROUP BY kk, rr)
"""


@reg.add("postings", sql="WITH " + _MERGED + "SELECT ord, n_members, sources, members FROM merged")
def q_dedup_cross_source(postings: DataFrame) -> DataFrame:
    """Roles merged across sources."""
    d = Q.dedup_cross_source(postings)
    return d.select("ord", F.col("n_members").cast("bigint").alias("n_members"), F.array_join("sources", "+").alias("sources"), F.array_join(F.transform("members", lambda m: F.concat(m["source"], F.lit(":"), m["sid"])), ",").alias("members"))


@reg.add("postings", sql=f"""WITH halves AS (SELECT *, CASE WHEN fetched_at >= TIMESTAMP '2026-05-01' THEN 0 ELSE 1 END AS age, {S.url_norm('url')} AS k FROM postings)
SELECT ord, age FROM halves WHERE k = '' UNION ALL SELECT ord, age FROM (SELECT * FROM halves WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY age, ord) = 1)""")
def q_merge_rows(postings: DataFrame) -> DataFrame:
    """New rows over existing rows by link; rows without a link all stay."""
    p = postings.select("ord", "url", F.when(F.col("fetched_at") >= "2026-05-01", 0).otherwise(1).alias("age"))
    return Q.merge_new_over_existing(p.filter("age = 0"), p.filter("age = 1"), T.url_norm("url"), [F.col("ord")]).select("ord", "age")


_SOFT = S.soft_key()


@reg.add("postings", sql=f"""WITH s AS (SELECT ord, source, url, {S.norm_key('company')} = '' AS masked, {_SOFT} AS k FROM postings),
f AS (SELECT *, first_value(ord) OVER w AS ford, first_value(source) OVER w AS fsrc, first_value(coalesce(url, '')) OVER w AS furl FROM s WHERE k IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY ord))
SELECT ord, k, CASE WHEN ford < ord AND (masked OR source IS DISTINCT FROM fsrc) THEN furl END AS blocked_by FROM f UNION ALL SELECT ord, k, NULL FROM s WHERE k IS NULL""")
def q_run_suppression(postings: DataFrame) -> DataFrame:
    """Reposts inside one run, with the row that owns the key."""
    x = postings.select("ord", "source", "url", T.soft_key("company", "title", "region", "city", "desc").alias("k"), (T.norm_key("company") == "").alias("masked"))
    return Q.suppress_within_run(x, "k", F.col("masked")).select("ord", "k", "blocked_by")


_REG = f"""reg AS (SELECT {_SOFT} AS k, strftime(max(fetched_at), '%Y-%m-%d') AS seen, arg_max(coalesce(url, ''), ord) AS u, arg_max(source, ord) AS src, arg_max({S.norm_key('city')}, ord) AS city
  FROM postings WHERE fetched_at < TIMESTAMP '2026-06-01' AND {_SOFT} IS NOT NULL GROUP BY 1),
leg AS (SELECT k, seen, u, src, city FROM (SELECT CASE WHEN {S.norm_key('company')} <> '' THEN {S.norm_key('company')} || '|' || {S.norm_key('title')} END AS k, strftime(max(fetched_at), '%Y-%m-%d') AS seen, '' AS u, '' AS src, NULL AS city
  FROM postings WHERE fetched_at < TIMESTAMP '2026-03-01' GROUP BY 1) WHERE k IS NOT NULL)"""


def _registry(postings: DataFrame) -> DataFrame:
    x = postings.select("ord", "source", "url", "fetched_at", T.soft_key("company", "title", "region", "city", "desc").alias("soft"), T.legacy_key("company", "title").alias("legacy"), T.norm_key("city").alias("city"))
    seen = lambda: F.date_format(F.max("fetched_at"), "yyyy-MM-dd").alias("seen")
    soft = x.filter("soft is not null and fetched_at < '2026-06-01'").groupBy(F.col("soft").alias("k")).agg(seen(), F.max_by(T.text("url"), "ord").alias("u"), F.max_by("source", "ord").alias("src"), F.max_by("city", "ord").alias("city"))
    old = x.filter("legacy is not null and fetched_at < '2026-03-01'").groupBy(F.col("legacy").alias("k")).agg(seen(), F.lit("").alias("u"), F.lit("").alias("src"), F.lit(None).cast("string").alias("city"))
    return soft.unionByName(old)


_BLOCK = lambda t: f"({t}.k IS NOT NULL AND NOT coalesce(date_diff('day', CAST({t}.seen AS DATE), DATE '{AS_OF}') > 30, false) AND NOT coalesce({t}.src <> '' AND {t}.src = j.source AND {t}.city IS NOT NULL AND {t}.city <> j.city_key, false))"


@reg.add("postings", sql=f"""WITH {_REG}, reg_all AS (SELECT * FROM reg UNION ALL SELECT * FROM leg),
j AS (SELECT ord, source, {S.norm_key('city')} AS city_key, {_SOFT} AS soft, CASE WHEN {S.norm_key('company')} <> '' THEN {S.norm_key('company')} || '|' || {S.norm_key('title')} END AS legacy FROM postings WHERE fetched_at >= TIMESTAMP '2026-06-01')
SELECT j.ord, CASE WHEN {_BLOCK('a')} THEN coalesce(a.u, '') WHEN {_BLOCK('b')} THEN coalesce(b.u, '') END AS blocked_by FROM j LEFT JOIN reg_all a ON j.soft = a.k LEFT JOIN reg_all b ON j.legacy = b.k""")
def q_soft_registry(postings: DataFrame) -> DataFrame:
    """Reposts against the registry of earlier runs, by two alternative keys with a time to live."""
    j = postings.filter("fetched_at >= '2026-06-01'").select("ord", "source", T.norm_key("city").alias("city_key"), T.soft_key("company", "title", "region", "city", "desc").alias("soft"), T.legacy_key("company", "title").alias("legacy"))
    return ST.soft_block(j, _registry(postings), AS_OF).select("ord", "blocked_by")


@reg.add("postings", sql=f"""WITH {_REG}, j AS (SELECT ord, coalesce(url, '') AS url, source, {S.norm_key('city')} AS city_key, {_SOFT} AS soft FROM postings WHERE fetched_at >= TIMESTAMP '2026-06-01'),
new AS (SELECT soft AS k, '{AS_OF}' AS seen, arg_max(url, ord) AS u, arg_max(source, ord) AS src FROM j WHERE soft IS NOT NULL GROUP BY soft)
SELECT k, seen, u, src FROM new UNION ALL SELECT k, seen, u, src FROM (SELECT * FROM reg UNION ALL SELECT * FROM leg) WHERE k NOT IN (SELECT k FROM new)""")
def q_register(postings: DataFrame) -> DataFrame:
    """The registry after a run."""
    j = postings.filter("fetched_at >= '2026-06-01'").select("ord", T.text("url").alias("url"), "source", T.norm_key("city").alias("city_key"), T.soft_key("company", "title", "region", "city", "desc").alias("soft"))
    return ST.register(j, _registry(postings), AS_OF).select("k", "seen", "u", "src")


@reg.add("events", sql="""WITH RECURSIVE d AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events),
f AS (SELECT user_id, event_type, min(day) AS day FROM d GROUP BY 1, 2 UNION ALL
  SELECT f.user_id, f.event_type, (SELECT min(d.day) FROM d WHERE d.user_id = f.user_id AND d.event_type = f.event_type AND d.day > f.day + 7) AS day FROM f WHERE f.day IS NOT NULL)
SELECT user_id, event_type, day FROM f WHERE day IS NOT NULL""")
def q_soft_ttl(events: DataFrame) -> DataFrame:
    """Events admitted under a key that expires after 7 days."""
    return ST.admitted_by_ttl(events, ["user_id", "event_type"], "ts", 7)


@reg.add("postings", sql="WITH " + _MERGED + """SELECT m.ord FROM merged m WHERE EXISTS (SELECT 1 FROM (SELECT unnest(m.member_ords) AS o) x JOIN postings p ON p.ord = x.o
  JOIN (SELECT DISTINCT coalesce(source, '') AS s, coalesce(sid, '') AS i FROM postings WHERE fetched_at < TIMESTAMP '2026-03-01') seen ON seen.s = coalesce(p.source, '') AND seen.i = coalesce(p.sid, ''))""")
def q_seen_members(postings: DataFrame) -> DataFrame:
    """Merged roles of which any member was seen before."""
    ident = F.concat_ws("\u0001", T.text("source"), T.text("sid"))
    seen = postings.filter("fetched_at < '2026-03-01'").select(ident.alias("id"))
    members = Q.dedup_cross_source(postings).select(F.col("ord").alias("k"), F.explode("members").alias("m")).select("k", F.concat_ws("\u0001", "m.source", "m.sid").alias("id"))
    return ST.known_members(members, seen).select(F.col("k").alias("ord"))


@reg.add("postings", sql="SELECT ord FROM postings QUALIFY row_number() OVER (PARTITION BY source ORDER BY fetched_at DESC, ord) <= 60 OR source LIKE 'stackhire:%'")
def q_newest_per_group(postings: DataFrame) -> DataFrame:
    """The newest 60 postings of a source, one family uncapped."""
    return Q.newest_per_group(postings, ["source"], [F.col("fetched_at").desc(), F.col("ord")], 60, F.coalesce(F.col("source").like("stackhire:%"), F.lit(False))).select("ord")


@reg.add("postings", sql="""SELECT ord, turn FROM (SELECT ord, row_number() OVER (ORDER BY rn, source) AS turn FROM (SELECT ord, source, row_number() OVER (PARTITION BY source ORDER BY ord) AS rn FROM postings) WHERE rn <= 15) WHERE turn <= 110""")
def q_round_robin(postings: DataFrame) -> DataFrame:
    """Detail reads dealt round-robin over sources within budgets."""
    return Q.round_robin(postings, "source", [F.col("ord")], 15, 110).select("ord", F.col("turn").cast("bigint").alias("turn"))


@reg.add("page_rows", sql="""WITH p AS (SELECT row_id, pull_date, coalesce(verdict, '') IN ('YES', 'REACH') OR coalesce(important, false) OR coalesce(tailor_ready, false) AS keep FROM page_rows),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT keep) AS free FROM p)
SELECT row_id FROM p WHERE keep UNION ALL SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY pull_date, row_id DESC) AS rn FROM p WHERE NOT keep), n WHERE rn > least(greatest(n.n - 120, 0), n.free)""")
def q_cap_protected(rows: DataFrame) -> DataFrame:
    """The page cut to 120 rows without touching protected ones."""
    r = rows.withColumn("ord", F.col("row_id"))
    keep = T.text("verdict").isin("YES", "REACH") | F.coalesce("important", F.lit(False)) | F.coalesce("tailor_ready", F.lit(False))
    return Q.cap_protected(r, keep, 120, [F.col("pull_date").desc(), F.col("row_id")]).select("row_id")


@reg.add("documents", sql="""SELECT doc_id, rn, used FROM (SELECT doc_id, row_number() OVER w AS rn, CAST(sum(coalesce(n_chars, 0) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE rn <= 12 AND (rn = 1 OR used <= 3800)""")
def q_budget_prefix(docs: DataFrame) -> DataFrame:
    """Digest lines of each source that fit the budget."""
    return Q.budget_prefix(docs, ["source"], [F.col("doc_id")], F.coalesce("n_chars", F.lit(0)) + 1, 3800, 12).select("doc_id", F.col("rn").cast("bigint").alias("rn"), "used")


@reg.add("postings", sql="WITH " + S.FACTS + "SELECT ord, rn, CAST((rn - 1) // 10 AS INTEGER) AS message FROM (SELECT ord, row_number() OVER (ORDER BY referral DESC, ord) AS rn FROM fitted WHERE (referral OR giant) AND (lane = 'apply' OR tailor)) WHERE rn <= 60")
def q_alert_batches(postings: DataFrame) -> DataFrame:
    """Alerts in messages of ten, referrals first."""
    act = (F.col("referral") | F.col("giant")) & ((F.col("lane") == "apply") | F.col("tailor"))
    c = C.only(C.classify(C.facts(C.normalize(postings))).withColumn("act", act), "act")
    return B.alert_batches(c.select("ord", "referral")).select("ord", F.col("rn").cast("bigint").alias("rn"), "message")


_BK = "WITH " + S.FACTS + "," + S.ROUTES + f""", rows_ AS (SELECT row_number() OVER (ORDER BY f.ord, reason) AS rid, f.ord, reason, {S.url_norm('f.url')} AS u, f.junior_title FROM routes JOIN fitted f USING (ord) WHERE bucket = 'review'),
page AS (SELECT DISTINCT {S.url_norm('url')} AS u FROM fitted WHERE {S.ON_PAGE}), giant AS (SELECT DISTINCT {S.url_norm('f.url')} AS u FROM routes JOIN fitted f USING (ord) WHERE bucket = 'giant'),
t AS (SELECT r.*, CASE WHEN u <> '' AND u IN (SELECT u FROM page) THEN 'on-page' WHEN u <> '' AND u IN (SELECT u FROM giant) THEN 'in-giant' END AS cause FROM rows_ r),
o AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN cause IS NULL AND u <> '' THEN u ELSE 'r' || rid END ORDER BY junior_title DESC, ord) AS du FROM t),
c AS (SELECT *, row_number() OVER (PARTITION BY cause IS NULL AND du = 1 ORDER BY junior_title DESC, ord) AS rn FROM o),
fate AS (SELECT ord, reason, CASE WHEN cause IS NOT NULL THEN cause WHEN du > 1 THEN 'dup-url' WHEN rn > 50 THEN 'cap' ELSE 'kept' END AS fate FROM c) """


def _review_bucket(postings: DataFrame) -> DataFrame:
    routed = cut(C.routed(C.classify(C.facts(C.normalize(postings)))).select("ord", "routes", "on_page", "company", "title", "url", "region", "city", "source", "desc", "junior_title"))
    rows = C.bucket_rows(routed)
    on_page = routed.filter("on_page").select("url")
    return B.finish_bucket(rows.filter("bucket = 'review'"), [("on-page", on_page), ("in-giant", rows.filter("bucket = 'giant'").select("url"))], 50, [~F.col("junior_title"), F.col("ord")])


@reg.add("postings", sql=_BK + "SELECT ord, reason, fate FROM fate")
def q_bucket_finish(postings: DataFrame) -> DataFrame:
    """The review bucket: drop sets, repeated links and the cap."""
    return _review_bucket(postings).select("ord", "reason", "fate")


@reg.add("postings", sql=_BK + "SELECT trim(split_part(reason, ':', 1)) AS tag, fate, count(*) AS n, min(ord) AS first_ord FROM fate GROUP BY 1, 2")
def q_bucket_counts(postings: DataFrame) -> DataFrame:
    """Counters of a bucket file by reason and by cause."""
    return _review_bucket(postings).groupBy(B.reason_tag().alias("tag"), "fate").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


@reg.add("postings", sql="""WITH stats AS (SELECT source, max(n) AS best, 1 AS zero_runs FROM (SELECT source, date_trunc('month', fetched_at) AS m, count(*) AS n FROM postings WHERE fetched_at < TIMESTAMP '2026-08-01' GROUP BY 1, 2) GROUP BY 1),
cur AS (SELECT source, count(*) AS n FROM postings WHERE fetched_at >= TIMESTAMP '2026-08-20' GROUP BY 1),
x AS (SELECT coalesce(s.source, c.source) AS source, coalesce(n, 0) AS n, coalesce(best, 0) AS best, coalesce(zero_runs, 0) AS zero_runs FROM stats s FULL JOIN cur c ON s.source = c.source)
SELECT source, n, CASE WHEN best >= 5 AND n <= 0 THEN 'dark' WHEN best >= 5 AND n < 0.3 * best THEN 'partial' WHEN best = 0 AND (CASE WHEN n <= 0 THEN zero_runs + 1 ELSE 0 END) >= 3 THEN 'never' ELSE 'ok' END AS state, greatest(best, n) AS new_best, CAST(CASE WHEN n <= 0 THEN zero_runs + 1 ELSE 0 END AS INTEGER) AS new_zero_runs FROM x""")
def q_source_health(postings: DataFrame) -> DataFrame:
    """Yield of each source against its best month."""
    monthly = postings.filter("fetched_at < '2026-08-01'").groupBy("source", F.date_trunc("month", "fetched_at").alias("m")).agg(F.count("*").alias("n"))
    stats = monthly.groupBy("source").agg(F.max("n").alias("best"), F.lit(1).alias("zero_runs"))
    now = postings.filter("fetched_at >= '2026-08-20'").groupBy("source").agg(F.count("*").alias("n"))
    return B.source_health(now, stats).select("source", "n", "state", "new_best", "new_zero_runs")


@reg.add("postings", sql="""WITH a AS (SELECT sid, min(title) AS title, min(city) AS city FROM postings WHERE source = 'hirevane' GROUP BY sid), b AS (SELECT sid, min(title) AS title, min(city) AS city FROM postings WHERE source = 'jobmarrow' GROUP BY sid)
SELECT coalesce(a.sid, b.sid) AS sid, coalesce(nullif(trim(a.title), ''), b.title) AS title, coalesce(nullif(trim(a.city), ''), b.city) AS city, CASE WHEN b.sid IS NULL THEN 'first' WHEN a.sid IS NULL THEN 'second' ELSE 'both' END AS feed FROM a FULL JOIN b ON a.sid = b.sid""")
def q_two_feed_union(postings: DataFrame) -> DataFrame:
    """Two feeds as one by key, the first winning."""
    feed = lambda s: postings.filter(F.col("source") == s).groupBy("sid").agg(F.min("title").alias("title"), F.min("city").alias("city"))
    return Q.two_feed_union(feed("hirevane"), feed("jobmarrow"), "sid", ["title", "city"])


@reg.add("postings", sql="""WITH d AS (SELECT sid, max("desc") AS "desc" FROM postings WHERE source = 'worklist' GROUP BY sid), l AS (SELECT sid, min(ord) AS ord FROM postings WHERE source = 'worklist' GROUP BY sid),
r AS (SELECT *, row_number() OVER (ORDER BY ord, sid) AS rn FROM l) SELECT r.sid, rn <= 80 AS enriched, CASE WHEN rn <= 80 THEN coalesce("desc", '') ELSE '' END AS "desc" FROM r JOIN d USING (sid)""")
def q_detail_budget(postings: DataFrame) -> DataFrame:
    """Details joined to the first 80 rows of a listing only."""
    w = postings.filter("source = 'worklist'")
    out = Q.enrich_within_budget(w.groupBy("sid").agg(F.min("ord").alias("ord")), w.groupBy("sid").agg(F.max("desc").alias("desc")), "sid", ["ord", "sid"], 80, "desc")
    return out.select("sid", "enriched", "desc")


@reg.add("postings", "places", sql="""WITH r AS (SELECT lower(trim(name_en)) AS n, min(place_id) AS place_id FROM places GROUP BY 1), h AS (SELECT ord, n, place_id, row_number() OVER (PARTITION BY ord ORDER BY length(n) DESC, n DESC) AS rn FROM postings JOIN r ON contains(lower(coalesce(city, '')), n))
SELECT p.ord, h.n AS rule, h.place_id FROM postings p LEFT JOIN h ON p.ord = h.ord AND h.rn = 1""")
def q_longest_match(postings: DataFrame, places: DataFrame) -> DataFrame:
    """Each city's longest contained place name."""
    rules = places.groupBy(F.lower(F.trim("name_en")).alias("n")).agg(F.min("place_id").alias("place_id"))
    return Q.longest_rule(postings, F.lower(T.text("city")), rules, "n", "place_id").select("ord", "rule", "place_id")


@reg.add("postings", sql=f"""SELECT ord FROM postings p WHERE source LIKE 'orbitats:%' AND NOT EXISTS (SELECT 1 FROM postings q WHERE q.source LIKE 'stackhire:%' AND {S.norm_key('q.title')} = {S.norm_key('p.title')})""")
def q_title_antijoin(postings: DataFrame) -> DataFrame:
    """Rows of one site whose title the other does not have."""
    t = postings.withColumn("nt", T.norm_key("title"))
    return t.filter("source like 'orbitats:%'").join(t.filter("source like 'stackhire:%'").select("nt").distinct(), "nt", "left_anti").select("ord")


@reg.add("postings", sql=f"""WITH f AS (SELECT source, {S.norm_key('title')} AS nt, arg_min(lower(coalesce(level, '')), ord) AS facet FROM postings WHERE coalesce(level, '') <> '' GROUP BY 1, 2)
SELECT p.ord, coalesce(nullif(lower(coalesce(p.level, '')), ''), f.facet, '') AS level FROM postings p LEFT JOIN f ON p.source = f.source AND {S.norm_key('p.title')} = f.nt""")
def q_facet_level(postings: DataFrame) -> DataFrame:
    """Levels from a facet look-up where the row has none."""
    t = postings.withColumn("nt", T.norm_key("title"))
    facet = t.filter("level <> ''").groupBy("source", "nt").agg(F.min_by(F.lower("level"), "ord").alias("facet"))
    return t.join(facet, ["source", "nt"], "left").select("ord", F.coalesce(F.nullif(F.lower(T.text("level")), F.lit("")), "facet", F.lit("")).alias("level"))


@reg.add("postings", sql=f"""SELECT source, count(*) AS n, round(avg(CAST({S.has('title', R.gate)} AS DOUBLE)), 6) AS term_share, avg(CAST({S.has('title', R.gate)} AS DOUBLE)) < 0.3 AS filter_ignored FROM postings GROUP BY source""")
def q_filter_share(postings: DataFrame) -> DataFrame:
    """Share of titles with the search term; a low one shows that a source ignored the filter."""
    hit = F.avg(T.has("title", R.gate).cast("double"))
    return postings.groupBy("source").agg(F.count("*").alias("n"), F.round(hit, 6).alias("term_share"), (hit < 0.3).alias("filter_ignored"))


_DIG = f"""items AS (SELECT row_id, {S.url_norm('url')} AS u, {S.title_key('role')} AS tk, CASE WHEN coalesce(region, '') = '' THEN 'Unknown' ELSE region END AS region, pull_date FROM page_rows),
mem AS (SELECT 'u:' || u AS k, pull_date AS seen FROM items WHERE pull_date < '2026-05-01' UNION ALL SELECT 't:' || tk || '|' || region, pull_date FROM items WHERE pull_date < '2026-03-01' UNION ALL SELECT 't:' || tk || '|*', pull_date FROM items WHERE pull_date < '2026-02-01'),
fresh AS (SELECT DISTINCT k FROM mem WHERE seen >= strftime(DATE '{AS_OF}' - 120, '%Y-%m-%d'))"""


@reg.add("page_rows", sql=f"""WITH {_DIG} SELECT row_id FROM items i WHERE pull_date >= '2026-05-01' AND NOT EXISTS (SELECT 1 FROM fresh WHERE k IN ('u:' || u, 't:' || tk || '|' || region, CASE WHEN region = 'Unknown' THEN 't:' || tk || '|*' END))""")
def q_digest_new(rows: DataFrame) -> DataFrame:
    """Digest items that no remembered key blocks."""
    region = F.when(T.text("region") == "", "Unknown").otherwise(F.col("region"))
    x = rows.select(F.col("row_id").alias("ord"), "url", T.title_key("role").alias("title_key"), region.alias("region"), "pull_date")
    mem = lambda before, k: x.filter(F.col("pull_date") < before).select(k.alias("k"), F.col("pull_date").alias("seen"))
    memory = mem("2026-05-01", F.concat(F.lit("u:"), T.url_norm("url"))).unionByName(mem("2026-03-01", F.concat(F.lit("t:"), F.col("title_key"), F.lit("|"), F.col("region")))).unionByName(mem("2026-02-01", F.concat(F.lit("t:"), F.col("title_key"), F.lit("|*"))))
    return B.digest_new(x.filter("pull_date >= '2026-05-01'"), memory, AS_OF).select(F.col("ord").alias("row_id"))
