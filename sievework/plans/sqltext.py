"""SQL spellings of the text rules, for checking against a second engine."""

from __future__ import annotations

from collections.abc import Iterable

from ..functions import extract as X
from ..functions.rules import RULES as R
from ..functions.text import FINGERPRINT, WORD, quoted


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(x: str, words: Iterable[str]) -> str:
    return f"regexp_matches(lower(coalesce({x}, '')), {lit(quoted(words))})"


def has_word(x: str, words: Iterable[str]) -> str:
    edge = r"[^\p{L}\p{N}\p{M}_]"
    return f"regexp_matches(lower(coalesce({x}, '')), {lit(f'(^|{edge})(?:{quoted(words)})($|{edge})')})"


def has_term(x: str, words: Iterable[str]) -> str:
    return f"regexp_matches(lower(coalesce({x}, '')), {lit(f'(^|[^a-z0-9])(?:{quoted(words)})($|[^a-z0-9])')})"


def count_words(x: str, words: Iterable[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(coalesce({x}, '')), {lit(w)}) AS INTEGER)" for w in words) + ")"


def words_of(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), {lit(WORD)})"


def company_is(x: str, names: Iterable[str]) -> str:
    line, joined = f"' ' || array_to_string({words_of(x)}, ' ') || ' '", f"array_to_string({words_of(x)}, '')"
    out = [f"regexp_matches({line}, {lit(f' (?:{quoted(names)}) ')})"]
    glued = [n.replace(" ", "") for n in names if len(n.replace(" ", "")) >= R.glued_letters]
    return "(" + " OR ".join([*out, *([f"regexp_matches({joined}, {lit(f'^(?:{quoted(glued)})(?:{quoted(R.corporate)})*$')})"] if glued else [])]) + ")"


def norm_key(x: str) -> str:
    s = f"lower(coalesce({x}, ''))"
    for sign, spelled in R.spelled_signs:
        s = f"replace({s}, {lit(sign)}, {lit(f' {spelled} ')})"
    s = rf"regexp_extract_all(regexp_replace({s}, '\([^)]*\)', ' ', 'g'), {lit(WORD)})"
    return f"array_to_string(list_filter({s}, lambda w: w NOT IN ({', '.join(map(lit, R.empty_words))})), ' ')"


def title_key(x: str) -> str:
    return f"array_to_string({words_of(x)}, ' ')"


def fingerprint(x: str) -> str:
    least, most, digits = FINGERPRINT
    joined = f"array_to_string({words_of(x)}, '')"
    return f"CASE WHEN length({joined}) >= {least} THEN left(sha1(left({joined}, {most})), {digits}) ELSE '' END"


def soft_key() -> str:
    """The soft key of a row of postings."""
    return f"""CASE WHEN {norm_key('company')} <> '' THEN {norm_key('company')} || '|' || {norm_key('title')} || '|' || coalesce(region, '')
  WHEN {fingerprint('"desc"')} <> '' THEN '|' || {norm_key('title')} || '|' || {norm_key('city')} || '|' || {fingerprint('"desc"')} END"""


def url_norm(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^\\s+|/*\\s*\\z', '', 'g')"


def host(x: str) -> str:
    return f"lower(regexp_extract(coalesce({x}, ''), '^\\s*<?[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#>\\s]*)', 1))"


def is_board(x: str) -> str:
    return f"regexp_matches({host(x)}, {lit(f'(?:^|[.])(?:{quoted(R.boards)})$')})"


def flat(x: str) -> str:
    return f"regexp_replace(translate(lower(coalesce({x}, '')), '–—' || chr(13) || chr(9) || chr(160), '--   '), ' +', ' ', 'g')"


def _before(n: int) -> str:
    return f"substr(s, CAST(greatest(a - {n}, 1) AS BIGINT), CAST(least({n}, a - 1) AS BIGINT))"


_OWN = (
    f"regexp_replace(regexp_extract({_before(X.OWN[0])}, {lit(X._STATEMENT + chr(92) + 'z')}, 0), '^.* - ', '') || ' # ' || "
    f"regexp_replace(regexp_extract(substr(s, e, {X.OWN[1]}), {lit('^' + X._STATEMENT)}, 0), {lit(X._NEXT)}, '')"
)
#: ord, ymin: years required by each posting's text, one row for each number found.
YEARS = f"""
  WITH f AS (SELECT ord, {flat('"desc"')} AS t FROM postings),
  x AS (SELECT ord, t, regexp_replace(t, {lit(X.RANGE)}, '\\1 ~ ', 'g') AS s FROM f),
  m AS (SELECT ord, s, regexp_extract_all(s, {lit(X.SINGLE)}, 0) AS w, regexp_extract_all(s, {lit(X.SINGLE)}, 1) AS l, regexp_extract_all(s, {lit(X.SINGLE)}, 2) AS n, string_split_regex(s, {lit(X.SINGLE)}) AS g FROM x),
  i AS (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM m),
  p AS (SELECT ord, s, n[i] AS n, CAST(1 + list_sum([length(y) FOR y IN g[1:i]]) + coalesce(list_sum([length(y) FOR y IN w[1:i - 1]]), 0) AS BIGINT) AS st, length(l[i]) AS ll, length(w[i]) AS wl FROM i),
  k AS (SELECT ord, s, n, st + ll AS a, st + wl AS e FROM p),
  counted AS (
    SELECT ord, CAST(ceil(CAST(n AS DOUBLE)) AS INTEGER) AS y FROM k WHERE NOT regexp_matches({_before(X.AROUND[0])}, {lit(X.BLOCK_BEFORE)}) AND NOT regexp_matches(substr(s, e, {X.AROUND[1]}), {lit(X.BLOCK_AFTER)})
      AND NOT regexp_matches({_OWN}, {lit(X.OPTIONAL)}) AND NOT regexp_matches(regexp_extract({_before(X.HEADER)}, {lit(X.LAST_HEADER)}, 1), {lit(f'^(?:{X.OPTIONAL_HEADER})$')})
    UNION ALL SELECT ord, CAST(ceil(CAST(unnest(regexp_extract_all(t, {lit(X.RANGE)}, 2)) AS DOUBLE)) AS INTEGER) FROM x)
  SELECT ord, max(y) AS ymin FROM counted WHERE y <= {X.MAX_YEARS} GROUP BY ord
"""

_HEAD = "regexp_replace(coalesce(title, ''), ',.*| [-–] .*|\\(.*', '')"
FACTS = f"""
facts AS (SELECT p.*, y.ymin_text, coalesce(years_min, y.ymin_text) AS ymin,
  ({has("title", R.gate)} OR {has_word("title", R.gate_words)}) AS gate, ({has("title", R.senior)} OR {has_word("title", R.senior_words)}) AS senior_title,
  ({has_word("title", R.student_words)} OR {has("title", R.student_he)} OR regexp_matches(trim(coalesce(title, '')), {lit('^(?:' + quoted(R.student_start) + ')')}) OR (source IN ({", ".join(map(lit, R.student_level_sources))}) AND lower(coalesce(level, '')) = 'student')) AS student,
  {has("title", R.junior)} AS junior_title, lower(coalesce(level, '')) IN ({", ".join(map(lit, R.junior_levels))}) AS junior_level,
  ({has_word("title", R.skip_words)} OR {has("title", R.guarded)} AND {has_word('"desc"', R.guards)}) AS foundation, ({has_word("title", R.experienced)} OR {has("title", R.experienced_he)}) AS experienced,
  ({has_word("title", R.tester)} AND NOT {has("title", R.automated)} AND ({has("title", R.manual)} OR {count_words('"desc"', R.automation_tools)} < {R.min_tools})) AS manual,
  {has_word("title", R.industrial)} AS industrial, {has("title", R.bench_test)} AS bench, {has("title", R.training)} AS training,
  ({has_term("title", R.gap_terms)} AND ({has_term(_HEAD, R.gap_terms)} OR NOT {has_term(_HEAD, R.core_terms)})) AS gap, {has_word("title", R.qa_words)} AS qa,
  {company_is("company", R.giants)} AS giant, {company_is("company", R.referral)} AS referral, length(trim(coalesce("desc", ''))) > 60 AS verified, {count_words('"desc"', R.signals)} AS signals
  FROM postings p LEFT JOIN (SELECT ord AS yord, ymin AS ymin_text FROM ({YEARS})) y ON p.ord = y.yord),
flags AS (SELECT *, referral OR giant AS known, junior_title OR junior_level OR coalesce(ymin <= 2, false) AS jr, senior_title OR coalesce(ymin >= 3, false) AS sen,
  coalesce(ymin >= 4, false) AS over4, coalesce(ymin = 3, false) AS three FROM facts),
ladder AS (SELECT *, CASE WHEN NOT gate THEN NULL {" ".join(f"WHEN {x} THEN 'skip/{R.reasons[x]}/0'" for x in ("bench", "manual", "industrial", "training", "foundation", "student"))}
  WHEN junior_title AND NOT senior_title AND over4 THEN 'review/{R.reasons["years"]}/0' WHEN experienced AND NOT senior_title AND NOT over4 THEN 'reach/{R.reasons["experienced"]}/' || CASE WHEN three OR known THEN '1' ELSE '0' END
  WHEN known AND (senior_title OR over4) THEN 'skip/{R.reasons["known_senior"]}/0' WHEN known AND three THEN 'reach/{R.reasons["known_three"]}/1' WHEN known AND jr THEN 'apply/{R.reasons["junior"]}/0' WHEN known THEN 'reach/{R.reasons["known"]}/1'
  WHEN jr AND NOT sen THEN 'apply/{R.reasons["junior"]}/0' WHEN senior_title OR over4 THEN 'skip/{R.reasons["senior"]}/0' WHEN three THEN 'reach/{R.reasons["three"]}/1' ELSE 'review/{R.reasons["open"]}/0' END AS l FROM flags),
gapped AS (SELECT *, gap AND split_part(l, '/', 1) IN ('apply', 'reach') AS g, coalesce(gap AND split_part(l, '/', 1) = 'apply' AND (ymin = 0 OR (ymin IS NULL AND (junior_title OR junior_level))), false) AS learn FROM ladder),
classed AS (SELECT *, CASE WHEN l IS NULL THEN NULL WHEN g AND NOT learn THEN 'reach' ELSE split_part(l, '/', 1) END AS lane,
  CASE WHEN l IS NULL THEN NULL WHEN learn THEN '{R.reasons["learn"]}' WHEN g THEN '{R.reasons["gap"]}' ELSE split_part(l, '/', 2) END AS why,
  coalesce((NOT (g AND NOT learn)) AND split_part(l, '/', 3) = '1' AND verified, false) AS tailor FROM gapped),
fitted AS (SELECT *, CASE WHEN lane IS NULL THEN NULL WHEN referral AND lane <> 'skip' THEN 5 WHEN lane = 'apply' THEN CASE WHEN region = 'North' THEN 5 ELSE 4 END
  WHEN lane IN ('reach', 'review') THEN CASE WHEN known THEN 4 ELSE 3 END ELSE 1 END AS fit FROM classed)
"""
_KEPT = f"(coalesce(region, '') NOT IN ({', '.join(map(lit, R.drop_regions))}) AND coalesce(active, true))"
ROUTES = f"""
routes AS (
  SELECT ord, 'giant' AS bucket, 'giant:' || CASE WHEN senior_title THEN 'senior' WHEN student THEN 'student' ELSE 'open' END AS reason FROM fitted WHERE {_KEPT} AND giant
  UNION ALL SELECT ord, 'qa', 'qa:not-dev-title' FROM fitted WHERE {_KEPT} AND lane IS NULL AND qa
  UNION ALL SELECT ord, 'review', CASE WHEN known THEN 'not-dev-title' WHEN signals >= {R.min_signals} THEN 'jd-signal' ELSE 'no-jd-title' END FROM fitted
    WHERE {_KEPT} AND lane IS NULL AND NOT qa AND (known OR signals >= {R.min_signals} OR (NOT verified AND NOT senior_title))
  UNION ALL SELECT ord, CASE WHEN qa THEN 'qa' ELSE 'review' END, CASE WHEN qa THEN 'qa:' || why ELSE why END FROM fitted WHERE {_KEPT} AND lane = 'skip'
  UNION ALL SELECT ord, 'review', 'review:' || why FROM fitted WHERE {_KEPT} AND lane = 'review')
"""
ON_PAGE = f"coalesce({_KEPT} AND (lane IN ('apply', 'reach') OR (lane = 'review' AND coalesce(region, '') IN ({', '.join(map(lit, R.page_regions))}))), false)"
