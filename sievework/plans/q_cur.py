"""Queries on the curation overlay as a whole and on what a run keeps, shows and sends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import text as T
from ..functions.rules import RULES as R
from ..operators import buckets as B
from ..operators import classify as C
from ..operators import curation as CU
from ..operators import relational as Q
from . import sqltext as S
from .base import Registry
from .q_text import classified

reg = Registry()
AS_OF = "2026-06-30"
_K = S.url_norm("url")
#: Which numbered links each map has, and its values as expressions of the number (the same in both engines).
_PICK = lambda n, *vs: f"CASE m % {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(vs)) + " END"
_SAID = {"verdict": _PICK(3, "NO", "YES", "REACH"), "why": "concat('why ', CAST(m % 9 AS STRING))", "score": "CAST(m % 100 AS INT)"}
_ENTRY = {"company": _PICK(4, "Acme Labs", "", "(masked)", "Bolt"), "role": _PICK(3, "Senior Data Engineer", "", "SQL and Spark engineer"), "region": _PICK(5, "North", "Center", "Abroad", "Unknown", ""), "loc": _PICK(3, "Here", "", "There")}
_MAPS: dict[str, tuple[int, dict[str, str]]] = {
    "verdicts": (4, _SAID), "feed": (5, _ENTRY | _SAID), "rescued": (7, _ENTRY | _SAID), "origin": (6, {"employer": _PICK(3, "Cord", "", "Acme Labs"), "direct_url": _PICK(2, "https://direct.example/1", "")}),
    "pins": (11, {"note": _PICK(2, "look", "")} | _ENTRY), "ready": (9, {"base": _PICK(2, "a", "b"), "employer": _PICK(2, "Delta", ""), "region": _PICK(2, "North", "")}), "reviewed": (8, {"ok": "true"}),
    "outsourced": (13, {"label": _PICK(2, "by link", "by hand")}), "clients": (17, {"client": "'Client'", "client_url": "'https://client.example'"}), "statuses": (10, {"status": _PICK(4, "Sent", "Skip", "Interview", "New")}),
}


def _maps(rows: DataFrame, accepted: DataFrame) -> dict[str, DataFrame]:
    k = lambda d, i: d.select(T.url_norm("url").alias("k"), i.alias("m"))
    base = k(rows, F.col("row_id")).unionByName(k(accepted, F.col("feed_id") + 1_000_000)).filter("k <> ''").groupBy("k").agg(F.min("m").alias("m"))
    return {n: base.filter(f"m % {every} = 0").select("k", *(F.expr(e).alias(c) for c, e in cols.items())) for n, (every, cols) in _MAPS.items()}


_SQLS = lambda e: e.replace("AS STRING", "AS VARCHAR").replace("AS INT)", "AS INTEGER)").replace("concat(", "concat(")
_ENTRIES = "base AS (SELECT k, min(m) AS m FROM (SELECT " + _K + " AS k, row_id AS m FROM page_rows UNION ALL SELECT " + _K + ", feed_id + 1000000 FROM accepted_urls) WHERE k <> '' GROUP BY k)" + "".join(
    f", {n} AS (SELECT k, {', '.join(f'{_SQLS(e)} AS {c}' for c, e in cols.items())} FROM base WHERE m % {every} = 0)" for n, (every, cols) in _MAPS.items()
)
_LAYER = lambda n: f"(coalesce(st.status IN ('Sent', 'Interview'), false) OR (coalesce(ve.verdict, {n}.verdict, '') <> 'NO' AND coalesce({n}.region, '') NOT IN ({', '.join(map(S.lit, R.drop_regions))})))"
_COPY = lambda n: f"c_{n} AS (SELECT row_id, arg_min({n}, i) AS x FROM (SELECT d.row_id, d.i, {n} FROM dk d JOIN {n} USING (k)) GROUP BY row_id)"
_FILL = lambda c, extra, blank, takes: f"CASE WHEN mt IS NOT NULL AND trim(coalesce(mt.{c}, '')) <> '' {extra} AND {takes} THEN trim(mt.{c}) ELSE {c} END".replace("BLANK", f"(trim(coalesce({c}, '')) IN ('', '(masked)'{blank}))")
_HOSTED = f"list_filter(string_split({S.host('url')}, '.'), lambda x: x NOT IN ('www', 'jobs', 'careers', 'boards', 'apply', 'example', 'test', 'com', 'org', 'net', 'io', 'co', 'il', ''))"
_FROM_HOST = f"CASE WHEN {S.is_board('url')} OR len({_HOSTED}) = 0 THEN '(masked)' ELSE array_to_string([upper(left(w, 1)) || substr(w, 2) FOR w IN string_split(replace(({_HOSTED})[1], '-', ' '), ' ')], ' ') END"
_CATS = [(k, S.count_words("role", ws)) for k, ws in R.categories]
_BEST = f"greatest({', '.join(c for _, c in _CATS)})"


@reg.add("page_rows", "accepted_urls", sql=f"""WITH {_ENTRIES},
have AS (SELECT {_K} AS k FROM page_rows UNION SELECT {S.url_norm('d.url')} FROM (SELECT unnest(dups) AS d FROM page_rows)),
cand AS (SELECT base.k, ve, fe, re, pi, {_LAYER('fe')} AS may_fe, {_LAYER('re')} AS may_re FROM base LEFT JOIN verdicts ve USING (k) LEFT JOIN feed fe USING (k) LEFT JOIN rescued re USING (k) LEFT JOIN pins pi USING (k) LEFT JOIN statuses st USING (k)
  WHERE k NOT IN (SELECT k FROM have WHERE k IS NOT NULL) AND (fe.k IS NOT NULL OR re.k IS NOT NULL OR pi.k IS NOT NULL)),
inj AS (SELECT k, 'feed' AS src, fe.company, fe.role, fe.region, fe.loc, coalesce(CASE WHEN ve.k IS NOT NULL THEN ve.verdict ELSE fe.verdict END, '') AS verdict, coalesce(ve.score, fe.score, 60) AS match FROM cand WHERE fe.k IS NOT NULL AND may_fe
  UNION ALL SELECT k, 'rescued', re.company, re.role, re.region, re.loc, coalesce(CASE WHEN ve.k IS NOT NULL THEN ve.verdict ELSE re.verdict END, ''), coalesce(ve.score, re.score, 60) FROM cand WHERE NOT (fe.k IS NOT NULL AND may_fe) AND re.k IS NOT NULL AND may_re
  UNION ALL SELECT k, 'pins', pi.company, pi.role, pi.region, pi.loc, coalesce(ve.verdict, ''), coalesce(ve.score, 60) FROM cand WHERE NOT (fe.k IS NOT NULL AND may_fe) AND NOT (re.k IS NOT NULL AND may_re) AND pi.k IS NOT NULL),
rows_ AS (SELECT row_id, url, company, role, loc, region, verdict, match, fit, src, {_K} AS k FROM page_rows
  UNION ALL SELECT NULL, k, coalesce(company, ''), coalesce(role, ''), coalesce(loc, ''), CASE WHEN coalesce(region, '') = '' THEN 'Unknown' ELSE region END, verdict, match, CASE WHEN src = 'pins' OR verdict = 'YES' THEN 5 ELSE 4 END, src, k FROM inj),
dk AS (SELECT row_id, i, {S.url_norm('dups[i].url')} AS k FROM (SELECT row_id, dups, unnest(range(1, len(dups) + 1)) AS i FROM page_rows)), {_COPY('pins')}, {_COPY('ready')}, c_rev AS (SELECT DISTINCT row_id FROM dk JOIN reviewed USING (k)),
a AS (SELECT r.*, CASE WHEN ve.k IS NOT NULL THEN coalesce(ve.verdict, '') WHEN fe.k IS NOT NULL THEN fe.verdict WHEN re.k IS NOT NULL THEN re.verdict ELSE r.verdict END AS verdict2, coalesce(CASE WHEN ve.k IS NOT NULL THEN ve.score WHEN fe.k IS NOT NULL THEN fe.score ELSE re.score END, r.match) AS match2,
  coalesce(CASE WHEN ve.k IS NOT NULL THEN ve.why WHEN fe.k IS NOT NULL THEN fe.why ELSE re.why END, '') AS why, fe.k IS NOT NULL AS from_feed, CASE WHEN fe.k IS NOT NULL THEN {{'company': fe.company, 'role': fe.role, 'region': fe.region, 'loc': fe.loc}} WHEN re.k IS NOT NULL THEN {{'company': re.company, 'role': re.role, 'region': re.region, 'loc': re.loc}} END AS mt,
  og.employer, og.direct_url, coalesce(rv.ok, false) OR cv.row_id IS NOT NULL AS gpt_reviewed, CASE WHEN pi.k IS NOT NULL THEN coalesce(nullif(pi.note, ''), 'important') WHEN cp.row_id IS NOT NULL THEN coalesce(nullif(cp.x.note, ''), 'important') END AS pin,
  rd.k IS NOT NULL OR cr.row_id IS NOT NULL AS tailor_ready, CASE WHEN rd.k IS NOT NULL THEN rd.employer ELSE cr.x.employer END AS r_emp, CASE WHEN rd.k IS NOT NULL THEN rd.region ELSE cr.x.region END AS r_reg, os.label AS os_label, cl.client, cl.client_url
  FROM rows_ r LEFT JOIN verdicts ve USING (k) LEFT JOIN feed fe USING (k) LEFT JOIN rescued re USING (k) LEFT JOIN origin og USING (k) LEFT JOIN pins pi USING (k) LEFT JOIN ready rd USING (k) LEFT JOIN reviewed rv USING (k) LEFT JOIN outsourced os USING (k) LEFT JOIN clients cl USING (k)
  LEFT JOIN c_rev cv ON r.row_id = cv.row_id LEFT JOIN c_pins cp ON r.row_id = cp.row_id LEFT JOIN c_ready cr ON r.row_id = cr.row_id),
b AS (SELECT * EXCLUDE (company, role, region, loc), {_FILL('company', "AND trim(mt.company) <> '(masked)'", '', "(src IN ('feed', 'rescued') IS TRUE OR BLANK)")} AS company, {_FILL('role', '', '', "(src IN ('feed', 'rescued') IS TRUE OR BLANK)")} AS role,
  {_FILL('region', "AND (trim(mt.region) <> 'Unknown' OR src IN ('feed', 'rescued') IS TRUE)", ", 'Unknown'", "(src IN ('feed', 'rescued') IS TRUE OR BLANK)")} AS region, {_FILL('loc', '', '', "src IN ('feed', 'rescued') IS TRUE")} AS loc FROM a),
c AS (SELECT * EXCLUDE (company), CASE WHEN coalesce(employer, '') <> '' AND employer <> trim(coalesce(company, '')) THEN coalesce(company, '') END AS company_listed, CASE WHEN coalesce(employer, '') <> '' AND employer <> trim(coalesce(company, '')) THEN employer ELSE company END AS company FROM b),
d AS (SELECT * EXCLUDE (company, region), CASE WHEN coalesce(company, '') IN ('', '(masked)') AND coalesce(r_emp, '') <> '' THEN r_emp ELSE company END AS company, CASE WHEN coalesce(region, '') IN ('', 'Unknown') AND coalesce(r_reg, '') <> '' THEN r_reg ELSE region END AS region FROM c),
e AS (SELECT * EXCLUDE (company), CASE WHEN trim(coalesce(company, '')) <> '' THEN company ELSE {_FROM_HOST} END AS company FROM d)
SELECT row_id, url, company, role, loc, region, verdict2 AS verdict, match2 AS match, fit, src, why, from_feed, company_listed, nullif(direct_url, '') AS orig, CASE WHEN {_BEST} < 2 THEN 'general' {" ".join(f"WHEN {x} = {_BEST} THEN {S.lit(n)}" for n, x in _CATS)} END AS label,
  gpt_reviewed, pin, tailor_ready, {S.company_is('company', R.referral)} AS referral, {S.company_is('company', R.referral)} OR {S.company_is('company', R.giants)} AS giant,
  coalesce(os_label, CASE {" ".join(f"WHEN {S.company_is("concat_ws(' | ', company, company_listed)", ns)} THEN {S.lit(n)}" for n, ns in R.company_rules)} END) AS outsourced_as, client, client_url FROM e""")
def q_apply_curation(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """The page under its whole overlay, injected rows included."""
    return CU.apply_curation(rows, _maps(rows, accepted))


@reg.add("page_rows", "accepted_urls", sql=f"""WITH {_ENTRIES} SELECT p.row_id FROM page_rows p LEFT JOIN statuses s ON s.k = {S.url_norm('p.url')}
WHERE coalesce(s.status IN ('Sent', 'Interview'), false) OR coalesce(important, false) OR NOT (upper(coalesce(verdict, '')) = 'NO' OR {S.host('p.url')} IN ('boards.stackhire.example') OR regexp_matches(coalesce(p.url, ''), '/careers/?$'))""")
def q_kept_rows(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rows that a NO, a dead host or a link to no job does not take off the page."""
    return CU.kept_rows(rows, _maps(rows, accepted)["statuses"], ("boards.stackhire.example",), "/careers/?$").select("row_id")


@reg.add("page_rows", "accepted_urls", sql=f"""WITH {_ENTRIES}, a AS (SELECT k, status AS v FROM statuses), b AS (SELECT k, {_PICK(4, "Sent", "New", "Skip", "Interview")} AS v FROM base WHERE m % 3 = 0), i AS (SELECT * FROM b WHERE v <> 'New')
SELECT coalesce(a.k, i.k) AS k, CASE WHEN i.k IS NULL OR coalesce(a.v, '') NOT IN ('', 'New') THEN a.v ELSE i.v END AS v, CASE WHEN i.k IS NULL THEN 'local' WHEN coalesce(a.v, '') IN ('', 'New') THEN 'imported' WHEN a.v = i.v THEN 'same' ELSE 'kept' END AS fate FROM a FULL JOIN i ON a.k = i.k""")
def q_import_overlay(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """Marks imported without overwriting local ones, with the conflicts."""
    local = _maps(rows, accepted)["statuses"].select("k", F.col("status").alias("v"))
    k = lambda d, i: d.select(T.url_norm("url").alias("k"), i.alias("m"))
    base = k(rows, F.col("row_id")).unionByName(k(accepted, F.col("feed_id") + 1_000_000)).filter("k <> ''").groupBy("k").agg(F.min("m").alias("m"))
    return CU.imported(local, base.filter("m % 3 = 0").select("k", F.expr(_PICK(4, "Sent", "New", "Skip", "Interview")).alias("v")))


_NAME = f"{S.title_key('company')} || '|' || {S.title_key('role')}"


@reg.add("page_rows", sql=f"""WITH j AS (SELECT {_K} AS k, {_NAME} AS t FROM page_rows WHERE row_id % 3 = 0) SELECT row_id FROM page_rows WHERE row_id % 3 <> 0 AND {_K} NOT IN (SELECT k FROM j WHERE k <> '') AND {_NAME} NOT IN (SELECT t FROM j)""")
def q_not_handled(rows: DataFrame) -> DataFrame:
    """Digest items that no judged row has, by link or by company and title."""
    return CU.not_handled(rows.filter("row_id % 3 <> 0"), rows.filter("row_id % 3 = 0")).select("row_id")


_LOW = "lower(coalesce(title, ''))"
for _a, _b in R.digest_reads:
    _LOW = f"replace({_LOW}, {S.lit(_a)}, {S.lit(_b)})"


@reg.add("postings", sql="WITH " + S.FACTS + f"""SELECT ord FROM fitted WHERE NOT gate AND ({S.has_word("title", R.digest_roles)} OR {S.has("title", R.digest_roles_he)})
AND NOT (senior_title OR {S.has_word("title", R.student_words)} OR {S.has("title", R.student_he)} OR regexp_matches(trim(coalesce(title, '')), {S.lit('^(?:' + T.quoted(R.student_start) + ')')}) OR foundation OR {S.has_word(_LOW, R.digest_skip)} OR industrial OR bench)""")
def q_digest_fit(postings: DataFrame) -> DataFrame:
    """Titles that missed the gate and may still be worth a word."""
    return postings.filter(~C.passes_gate("title") & CU.digest_fit("title", "desc")).select("ord")


@reg.add("postings", sql="""WITH best AS (SELECT coalesce(source, '') AS source, count(*) AS best FROM postings WHERE fetched_at < TIMESTAMP '2026-08-01' GROUP BY 1), cur AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM postings WHERE fetched_at >= TIMESTAMP '2026-08-20' GROUP BY 1),
i AS (SELECT b.source, CASE WHEN best >= 5 AND coalesce(n, 0) <= 0 THEN 'dark' WHEN best >= 5 AND coalesce(n, 0) < 0.3 * best THEN 'partial' ELSE 'ok' END AS state FROM best b LEFT JOIN cur USING (source)),
k AS (SELECT source || ':' || state AS key FROM i WHERE state <> 'ok'), sent AS (SELECT key FROM k WHERE length(key) % 2 = 0) SELECT key, key NOT IN (SELECT key FROM sent) AS new FROM k""")
def q_alerts_today(postings: DataFrame) -> DataFrame:
    """Source alerts told once a day."""
    src = T.text("source").alias("source")
    best = postings.filter("fetched_at < '2026-08-01'").groupBy(src).agg(F.count("*").alias("best"), F.lit(0).alias("zero_runs"))
    cur = postings.filter("fetched_at >= '2026-08-20'").groupBy(src).agg(F.count("*").alias("n"))
    issues = B.source_health(cur, best).filter("best > 0")
    key = F.concat_ws(":", "source", "state")
    sent = issues.filter((F.col("state") != "ok") & (F.length(key) % 2 == 0)).select(F.lit(AS_OF).alias("day"), key.alias("key"))
    new, keys = CU.alerts_today(issues, sent, AS_OF)
    return keys.join(new.select("key", F.lit(True).alias("new")), "key", "left").select("key", F.coalesce("new", F.lit(False)).alias("new"))


@reg.add("postings", sql="""SELECT coalesce(source, '') AS source, CAST(floor(date_diff('second', max(fetched_at), TIMESTAMP '2026-09-01 00:00:00') / 3600) AS INTEGER) AS hours, date_diff('second', date_trunc('second', max(fetched_at)), TIMESTAMP '2026-09-01 00:00:00') > 21600 AS stale FROM postings GROUP BY 1""")
def q_staleness(postings: DataFrame) -> DataFrame:
    """Age of each source's last row, and whether it is too old."""
    last = postings.groupBy(T.text("source").alias("source")).agg(F.max("fetched_at").cast("timestamp").alias("t"))
    return last.select("source", CU.staleness(F.date_trunc("second", "t"), "2026-09-01 00:00:00").alias("s")).select("source", "s.hours", "s.stale")


@reg.add("postings", sql="WITH " + S.FACTS + """, m AS (SELECT *, split_part(coalesce(source, ''), ':', 1) AS family FROM fitted WHERE lane IN ('apply', 'reach'))
SELECT ord, 'auto-2026-06-30-' || family || '-' || CAST(row_number() OVER (PARTITION BY family ORDER BY ord) - 1 AS VARCHAR) AS id, CASE WHEN coalesce(company, '') = '' THEN '(masked)' ELSE company END AS company, coalesce(source, '') AS src, (referral OR giant) AND (lane = 'apply' OR tailor) AS alert FROM m""")
def q_tracker_rows(postings: DataFrame) -> DataFrame:
    """Rows of the tracker with their ids, sources and alert flags."""
    roles = C.only(classified(postings).withColumn("act", F.col("lane").isin("apply", "reach")), "act").withColumn("sources", F.array(T.text("source")))
    return CU.tracker_rows(roles, AS_OF).select("ord", "id", "company", "src", "alert")


@reg.add("page_rows", sql="""SELECT row_id, '• ' || left(coalesce(company, ''), 30) || ' — ' || left(coalesce(role, ''), 70) || ' [' || CASE WHEN coalesce(region, '') = '' THEN '?' ELSE region END || ']' || chr(10) || left(coalesce(url, ''), 400) AS line FROM page_rows""")
def q_message_lines(rows: DataFrame) -> DataFrame:
    """Each row as an entry of a message."""
    return rows.select("row_id", CU.message_line().alias("line"))


@reg.add("page_rows", sql="""WITH l AS (SELECT row_id, CASE WHEN coalesce(region, '') IN ('', 'Unknown') THEN 1 ELSE 0 END AS u, '• ' || left(coalesce(company, ''), 30) || ' — ' || left(coalesce(role, ''), 70) || ' [' || CASE WHEN coalesce(region, '') = '' THEN '?' ELSE region END || ']' || chr(10) || left(coalesce(url, ''), 400) AS line FROM page_rows),
n AS (SELECT row_id, row_number() OVER w AS rn, 40 + sum(1 + length(line)) OVER (ORDER BY u, row_id ROWS UNBOUNDED PRECEDING) AS used FROM l WINDOW w AS (ORDER BY u, row_id)) SELECT row_id, rn, CAST(used AS BIGINT) AS used FROM n WHERE rn <= 12 AND (rn = 1 OR used <= 1200)""")
def q_digest_lines(rows: DataFrame) -> DataFrame:
    """The lines of one digest that fit behind its header, unknown regions last."""
    return CU.digest_lines(rows.withColumn("ord", F.col("row_id")), 40, 1_200).select("row_id", F.col("rn").cast("bigint").alias("rn"), F.col("used").cast("bigint").alias("used"))


@reg.add("page_rows", sql=f"""WITH t AS (SELECT {_K} AS u, {S.title_key('role')} AS tk, coalesce(region, '') AS region, pull_date FROM page_rows), old AS (SELECT 'u:' || u AS k, max(pull_date) AS seen FROM t WHERE pull_date < '2026-05-01' GROUP BY 1),
new AS (SELECT unnest(['u:' || u, 't:' || tk || '|' || region, 't:' || tk || '|*']) AS k, '2026-06-30' AS seen FROM t WHERE pull_date >= '2026-06-01') SELECT k, max(seen) AS seen FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY k""")
def q_digest_memory(rows: DataFrame) -> DataFrame:
    """The memory of a digest after it was delivered."""
    x = rows.select("url", T.title_key("role").alias("title_key"), T.text("region").alias("region"), "pull_date")
    old = x.filter("pull_date < '2026-05-01'").groupBy(F.concat(F.lit("u:"), T.url_norm("url")).alias("k")).agg(F.max("pull_date").alias("seen"))
    return CU.digest_memory(old, x.filter("pull_date >= '2026-06-01'"), AS_OF)


@reg.add("postings", sql="""WITH old AS (SELECT DISTINCT coalesce(source, '') || ':' || coalesce(sid, '') AS id, '2026-01-01' AS seen FROM postings WHERE fetched_at < TIMESTAMP '2026-05-01'), new AS (SELECT DISTINCT coalesce(source, '') || ':' || coalesce(sid, '') AS id FROM postings WHERE fetched_at >= TIMESTAMP '2026-05-01')
SELECT * FROM old UNION ALL SELECT id, '2026-06-30' FROM new WHERE id NOT IN (SELECT id FROM old)""")
def q_registered_members(postings: DataFrame) -> DataFrame:
    """Permanent ids after a run: new members come in, known ones keep their day."""
    x = postings.select(F.concat_ws(":", T.text("source"), T.text("sid")).alias("id"), "ord", "fetched_at")
    old = x.filter("fetched_at < '2026-05-01'").select("id").distinct().withColumn("seen", F.lit("2026-01-01"))
    return CU.registered_members(x.filter("fetched_at >= '2026-05-01'"), old, AS_OF)


@reg.add("postings", sql="""WITH x AS (SELECT ord, coalesce("desc", '') AS a, coalesce(title, '') || ' ' || coalesce("desc", '') AS b FROM postings), r AS (SELECT *, 1500 - CASE WHEN a <> '' AND b <> '' THEN 1 ELSE 0 END AS room FROM x),
f AS (SELECT *, least(length(a), greatest(900, room - length(b))) AS fa FROM r), s AS (SELECT *, least(length(b), greatest(room - fa, 0)) AS sb FROM f) SELECT ord, left(a, fa) || CASE WHEN a <> '' AND sb > 0 THEN chr(10) ELSE '' END || left(b, sb) AS both FROM s""")
def q_two_parts(postings: DataFrame) -> DataFrame:
    """Two texts in one budget."""
    return postings.select("ord", X.two_parts("desc", F.concat_ws(" ", T.text("title"), T.text("desc")), 1500).alias("both"))


@reg.add("postings", sql="""SELECT ord, array_to_string(list_filter([coalesce(source, ''), coalesce(title, ''), CAST(ord AS VARCHAR), array_to_string(coalesce(tech, []), ' '), CASE WHEN coalesce(active, true) THEN 'true' ELSE 'false' END, coalesce("desc", '')], lambda x: trim(x) <> ''), ' ') AS flat FROM postings""")
def q_flat_json(postings: DataFrame) -> DataFrame:
    """Nested JSON as its scalars in order."""
    doc = F.to_json(F.struct(T.text("source").alias("a"), F.struct(T.text("title").alias("t"), F.array(F.struct("ord")).alias("l")).alias("b"), F.coalesce("tech", F.array().cast("array<string>")).alias("tech"), F.coalesce("active", F.lit(True)).alias("on"), T.text("desc").alias("d")))
    return postings.select("ord", X.flat_json(doc).alias("flat"))


@reg.add("postings", sql=r"""SELECT ord, trim(regexp_replace(regexp_replace(coalesce("desc", ''), '(?is)we offer.{0,300}?\.', ' ', 'g'), '[ \t]{2,}', ' ', 'g')) AS body FROM postings""")
def q_without_spans(postings: DataFrame) -> DataFrame:
    """Texts without boilerplate from an opening to the nearest full stop."""
    return postings.select("ord", X.without_spans("desc", [("we offer", ".")]).alias("body"))


_ALIAS, _COUNTRY, _FAR = (("hq", "Main site"), ("remote", "Anywhere")), ("israel",), ("anywhere",)
_PARTS = r"""list_filter([trim(regexp_replace(x, '\([^)]*\)', '', 'g')) FOR x IN string_split_regex(coalesce(city, ''), '[;,/|]')], lambda x: x <> '' AND lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) NOT IN ('israel'))"""
_NAMED = rf"""[CASE lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) WHEN 'hq' THEN 'Main site' WHEN 'remote' THEN 'Anywhere' ELSE x END FOR x IN {_PARTS}]"""


@reg.add("postings", sql=f"""WITH n AS (SELECT ord, {_NAMED} AS xs FROM postings), u AS (SELECT ord, list_filter(xs, lambda x, i: list_position(xs, x) = i) AS xs FROM n), f AS (SELECT ord, xs, list_filter(xs, lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))) <> 'anywhere') AS ys FROM u)
SELECT ord, array_to_string(list_slice(CASE WHEN len(ys) > 0 THEN ys ELSE xs END, 1, 3), ' / ') AS city FROM f""")
def q_canonical_city(postings: DataFrame) -> DataFrame:
    """Cities of a location by aliases, without the country and without dropped ones."""
    return postings.select("ord", X.canonical_city("city", _ALIAS, _COUNTRY, _FAR).alias("city"))
