"""Problem 7: places as typed, mapped to a reference list; SQL only.

Method: pigeonhole join. Each reference word (the distinctive word of a place name, in either
script) of n letters is cut into k+1 segments; a typed word within k edits must hold one of them
unchanged, at most k positions away. For each length n that a reference may have, the typed word's
substrings at those places meet the segments in an equality join, the built-in ``levenshtein``
verifies, the nearest reference wins, and rows that name nothing come out of an anti join with
place -1. A word costs the same number of substrings whatever its length; words of fewer than
``SHORT`` letters allow no edit. A noise word counts only if the list holds it exactly.

Both sides are folded first (case, transliteration pairs such as w/v and q/k, doubled letters),
so those differences cost no edits. Of places with one name in two regions the row's region
decides (its own, else one its known copies carry); without a region the first listed.

Scale: only distinct words are joined with the list, whose size is fixed; rows meet the result
of their words by a salted join, so one place typed in a third of all rows is spread over
``SALT`` tasks. No cross join.

Defined results: null, empty and blank ``loc`` give no row; a place named twice in a row gives
one line; repeated rows give lines of their own; ties in distance give all nearest names;
an empty list sends every row to -1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ._common import query_reading

#: Edits allowed; a reference word is cut into EDITS + 1 segments.
EDITS = 2
#: Words shorter than this must be equal.
SHORT = 4
SALT = 8
#: Words that name no place (fixed values).
NOISE = ("remote", "hybrid", "israel", "area", "floor", "office", "locations", "location", "onsite", "center", "north", "south", "jerusalem", "abroad", "unknown", "multiple", "several", "various")

_FOLD = r"""regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(lower({x}), '[''’`׳]', ''), 'wqj', 'vky'), 'ch', 'sh'), '([a-z])\\1', '$1'), '([aeiou])h$', '$1')"""


def _fold(x: str) -> str:
    return _FOLD.format(x=x)


def _noise(fold) -> str:
    """The noise words as a list of folded literals of the dialect."""
    return ", ".join(fold("'" + w + "'") for w in NOISE)


#: Start and length of segment i of a word of n letters.
_AT = f"floor(i * n / {EDITS + 1})"
_LEN = f"floor((i + 1) * n / {EDITS + 1}) - floor(i * n / {EDITS + 1})"
#: Edits allowed between a typed word and a reference word.
_ALLOWED = f"CASE WHEN least(length(word), length(core)) < {SHORT} THEN 0 WHEN length(core) < 6 THEN 1 ELSE {EDITS} END"

_QUERY = f"""
WITH ref AS (  -- distinctive words: the last of a name
  SELECT DISTINCT place_id, region, {_fold("element_at(split(trim(name), '[ -]+'), -1)")} AS core
  FROM (SELECT place_id, region, explode(array(name_en, name_he)) AS name FROM {{places}}) WHERE trim(name) <> ''
), cores AS (SELECT DISTINCT core, length(core) AS n FROM ref WHERE core <> ''),
seg AS (  -- k+1 segments of each reference word, known by the word's length and their number
  SELECT core, concat_ws('|', n, i, substring(core, CAST({_AT} AS INT) + 1, CAST({_LEN} AS INT))) AS k
  FROM cores LATERAL VIEW explode(sequence(0, {EDITS})) s AS i
), typed AS (
  SELECT row_id, region, CAST(pmod(row_id, {SALT}) AS INT) AS salt, explode(array_distinct(transform(
           filter(split(regexp_replace(loc, '[''’`׳"]', ''), '[^\\\\p{{{{L}}}}]+'), w -> w <> ''), w -> {_fold("w")}))) AS word
  FROM {{rows}} WHERE trim(loc) <> ''
), every AS (SELECT DISTINCT word FROM typed WHERE word <> ''),
words AS (SELECT word FROM every WHERE word NOT IN ({_noise(_fold)}) UNION SELECT word FROM every JOIN cores ON word = core),
part AS (  -- what such segments would be if the typed word came from a word of n letters, moved by d
  SELECT word, concat_ws('|', n, i, substring(word, CAST({_AT} AS INT) + 1 + d, CAST({_LEN} AS INT))) AS k
  FROM words LATERAL VIEW explode(sequence(greatest(length(word) - {EDITS}, 1), length(word) + {EDITS})) a AS n
  LATERAL VIEW explode(sequence(0, {EDITS})) b AS i LATERAL VIEW explode(sequence(-{EDITS}, {EDITS})) c AS d WHERE {_AT} + 1 + d >= 1
), near AS (SELECT DISTINCT word, core, levenshtein(word, core) AS d FROM part JOIN seg USING (k) WHERE levenshtein(word, core) <= {_ALLOWED}),
best AS (SELECT word, core FROM (SELECT *, min(d) OVER (PARTITION BY word) AS dmin FROM near) WHERE d = dmin),
named AS (SELECT word, core, collect_list(struct(place_id, region)) AS places FROM best JOIN ref USING (core) GROUP BY word, core),
spread AS (SELECT *, explode(sequence(0, {SALT - 1})) AS salt FROM named),
hit AS (  -- of places with one name: the row's region, else the first
  SELECT DISTINCT row_id, coalesce(
    array_min(transform(filter(places, p -> p.region = t.region), p -> p.place_id)), array_min(transform(places, p -> p.place_id))) AS place_id
  FROM typed t JOIN spread USING (word, salt)
)
SELECT row_id, place_id FROM hit
UNION ALL
SELECT row_id, -1 AS place_id FROM {{rows}} r LEFT ANTI JOIN hit USING (row_id) WHERE trim(loc) <> ''
"""


def named_places(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``row_id, place_id`` for each place that ``loc`` names; -1 where it names none.

    ``rows`` has row_id, loc and region; other columns are ignored.
    """
    spark = rows.sparkSession
    return spark.sql(_QUERY, rows=rows.select("row_id", "loc", "region"), places=places.select("place_id", "name_en", "name_he", "region"))


def with_copy_region(rows: DataFrame) -> DataFrame:
    """``rows`` whose missing or unknown region is taken from the first copy that knows one."""
    return rows.selectExpr(
        "row_id", "loc",
        "CASE WHEN coalesce(region, '') NOT IN ('', 'Unknown') THEN region ELSE try_element_at(filter(coalesce(dups.region, array()), r -> coalesce(r, '') NOT IN ('', 'Unknown')), 1) END AS region",
    )


@query_reading("page_rows", "places")
def p7_found(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Places named by the page rows."""
    return named_places(with_copy_region(rows), places)


QUERIES = {"p7_found": p7_found}

def _duck_fold(x: str) -> str:
    """The same fold; a doubled letter is spelled out, as the dialect has no back references."""
    y = f"translate(regexp_replace(lower({x}), '[''’`׳]', '', 'g'), 'wqj', 'vky')"
    y = f"replace({y}, 'ch', 'sh')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        y = f"replace({y}, '{c}{c}', '{c}')"
    return rf"regexp_replace({y}, '([aeiou])h$', '\1')"


#: The dialect counts edits of bytes, so Hebrew letters are given one byte each first.
_EDITS = "levenshtein({})".format(", ".join(f"translate({x}, 'אבגדהוזחטיךכלםמןנסעףפץצקרשת', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0')" for x in ("word", "core")))
#: Brute force: every distinct word against every reference word.
SQL = {
    "p7_found": f"""
WITH ref AS (SELECT DISTINCT place_id, region, {_duck_fold("string_split(replace(trim(name), '-', ' '), ' ')[-1]")} AS core
  FROM (SELECT place_id, region, unnest([name_en, name_he]) AS name FROM places) WHERE trim(name) <> ''),
r AS (SELECT row_id, loc, CASE WHEN coalesce(region, '') NOT IN ('', 'Unknown') THEN region
  ELSE list_filter([d.region FOR d IN coalesce(dups, [])], lambda x: coalesce(x, '') NOT IN ('', 'Unknown'))[1] END AS region FROM page_rows WHERE trim(loc) <> ''),
typed AS (SELECT DISTINCT row_id, region, {_duck_fold("w")} AS word FROM (
  SELECT row_id, region, unnest(string_split_regex(regexp_replace(loc, '[''’`׳"]', '', 'g'), '[^\\p{{L}}]+')) AS w FROM r) WHERE w <> ''),
words AS (SELECT DISTINCT word FROM typed WHERE word <> '' AND (word NOT IN ({_noise(_duck_fold)}) OR word IN (SELECT core FROM ref))),
near AS (SELECT word, core, {_EDITS} AS d FROM words, (SELECT DISTINCT core FROM ref)
  WHERE core <> '' AND {_EDITS} <= {_ALLOWED}),
best AS (SELECT word, core FROM near QUALIFY d = min(d) OVER (PARTITION BY word)),
hit AS (SELECT DISTINCT t.row_id, coalesce(min(place_id) FILTER (WHERE ref.region = t.region), min(place_id)) AS place_id
  FROM typed t JOIN best USING (word) JOIN ref USING (core) GROUP BY t.row_id, t.word, core)
SELECT row_id, place_id FROM hit UNION ALL SELECT row_id, -1 FROM r WHERE row_id NOT IN (SELECT row_id FROM hit)
"""
}
