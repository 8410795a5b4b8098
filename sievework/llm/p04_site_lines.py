"""Problem 4: lines that one source repeats in many of its postings.

Method: hash the normalised lines, count the distinct rows of each (source, hash), keep those
above an absolute and a relative threshold, join back, and rebuild texts without them.

Scale: equal lines of one text are counted once by an array distinct before anything is
shuffled, and counts are combined on the map side, so a source with a third of all rows costs
partial aggregates only. At most ``1 / share`` x lines-per-row lines of a source can pass the
threshold; the table of passing lines is written, counted, and broadcast only below a bound -
beyond it the join back shuffles.

Defined results: lines are split at ``\\n`` and numbered from 1; a null or empty text has no
lines; a null source counts as ''; rows with missing text count as rows of their source; a line
repeated inside one text is one row for the threshold but every occurrence comes out; ties do
not occur; other columns pass through ``remove_site_lines`` untouched; empty tables give no
rows. A line is known by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checked_broadcast, cut, query_reading

MIN_CHARS = 25
MIN_ROWS = 5
MIN_SHARE = 0.05
#: White space other than the line break, no-break spaces included (fixed values).
_OTHER = r"\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs to be made one space; a single plain space already is one.
SPACE = rf"[ {_OTHER}]{{2,}}|[{_OTHER}]"


def norm_lines(text: Column) -> Column:
    """Lines of ``text`` with white space squeezed, trimmed and lower-cased."""
    return F.transform(F.split(F.regexp_replace(F.lower(text), SPACE, " "), "\n"), lambda x: F.trim(x))


def line_id(line: Column) -> Column:
    """128 bits that stand for a line: the line hashed from two seeds, neither half follows from the other."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def frequent_lines(rows: DataFrame, min_chars: int = MIN_CHARS, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> DataFrame:
    """``source, a, b, n_rows, share`` of the lines above both thresholds (checkpointed)."""
    keyed = rows.select(F.coalesce("source", F.lit("")).alias("source"), "desc")
    totals = keyed.groupBy("source").agg(F.count("*").alias("total"))
    lines = F.array_distinct(F.transform(F.filter(norm_lines(F.col("desc")), lambda x: F.length(x) >= min_chars), line_id))
    counted = (
        keyed.select("source", F.explode(lines).alias("id"))
        .groupBy("source", F.col("id.a").alias("a"), F.col("id.b").alias("b"))
        .agg(F.count("*").alias("n_rows"))
        .filter(F.col("n_rows") >= min_rows)
    )
    return cut(
        counted.join(totals, "source")
        .filter(F.col("n_rows") >= F.lit(min_share) * F.col("total"))
        .select("source", "a", "b", "n_rows", (F.col("n_rows") / F.col("total")).alias("share"))
    )


def marked_lines(rows: DataFrame, key: str = "ord", **limits) -> DataFrame:
    """``<key>, line_no`` of each occurrence of a frequent line."""
    frequent = checked_broadcast(frequent_lines(rows, **limits).select("source", "a", "b"))
    min_chars = limits.get("min_chars", MIN_CHARS)
    each = (
        rows.select(key, F.coalesce("source", F.lit("")).alias("source"), F.posexplode(norm_lines(F.col("desc"))).alias("pos", "line"))
        .filter(F.length("line") >= min_chars)
        .select(key, "source", "pos", line_id(F.col("line")).alias("id"))
        .select(key, "source", "pos", "id.a", "id.b")
    )
    return each.join(frequent, ["source", "a", "b"], "left_semi").select(key, (F.col("pos") + 1).cast("int").alias("line_no"))


def remove_site_lines(rows: DataFrame, key: str = "ord", **limits) -> DataFrame:
    """``rows`` with ``clean_desc`` (texts without frequent lines, line ends as they were) and ``n_removed``."""
    marks = marked_lines(rows, key, **limits).groupBy(key).agg(F.collect_list("line_no").alias("_nos"))  # bounded by the lines of one text
    kept = F.filter(F.split("desc", "\n"), lambda x, i: ~F.array_contains(F.coalesce("_nos", F.expr("array()").cast("array<int>")), i + 1))
    return (
        rows.join(marks, key, "left")
        .withColumn("clean_desc", F.when(F.col("_nos").isNull(), F.col("desc")).otherwise(F.array_join(kept, "\n")))
        .withColumn("n_removed", F.coalesce(F.size("_nos"), F.lit(0)))
        .drop("_nos")
    )


@query_reading("postings")
def p4_found(postings: DataFrame) -> DataFrame:
    """Each occurrence of a line that its source repeats."""
    return marked_lines(postings)


@query_reading("postings")
def p4_clean(postings: DataFrame) -> DataFrame:
    """Each posting's text without the lines of its site."""
    return remove_site_lines(postings.select("ord", "source", "desc")).select("ord", "clean_desc", "n_removed")


QUERIES = {"p4_found": p4_found, "p4_clean": p4_clean}

_LINES = r"""
WITH ln AS (
  SELECT ord, source, pos, raw, lower(trim(regexp_replace(raw, '[\t\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS line
  FROM (SELECT ord, coalesce(source, '') AS source, unnest(string_split("desc", chr(10))) AS raw,
               unnest(range(1, len(string_split("desc", chr(10))) + 1)) AS pos FROM postings)
), tot AS (SELECT coalesce(source, '') AS source, count(*) AS total FROM postings GROUP BY 1),
freq AS (
  SELECT l.source, line FROM (SELECT DISTINCT ord, source, line FROM ln WHERE length(line) >= 25) l JOIN tot USING (source)
  GROUP BY l.source, line, total HAVING count(*) >= 5 AND count(*) >= 0.05 * total
)
"""
SQL = {
    "p4_found": _LINES + "SELECT ord, CAST(pos AS INTEGER) AS line_no FROM ln JOIN freq USING (source, line)",
    "p4_clean": _LINES
    + """SELECT p.ord, CASE WHEN coalesce(g.n_removed, 0) = 0 THEN p."desc" ELSE coalesce(g.clean_desc, '') END AS clean_desc, CAST(coalesce(g.n_removed, 0) AS INTEGER) AS n_removed
FROM postings p LEFT JOIN (
  SELECT ln.ord, string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE f.line IS NULL) AS clean_desc, count(f.line) AS n_removed
  FROM ln LEFT JOIN freq f ON ln.source = f.source AND ln.line = f.line GROUP BY ln.ord) g USING (ord)""",
}
