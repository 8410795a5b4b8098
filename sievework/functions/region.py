"""Region of a free-text location.

A location is a list of fragments, a fragment a list of words. Runs of words are looked up in a
table of place names (an equality join; Hebrew words also without up to two prefix letters), a
fragment has the foremost region of the places it names, and a location is decided by the set of
its fragments' regions, held as bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import RULES, Rules
from .text import ColumnLike, col, text

#: Regions in order of precedence; a named fragment of none of them is Center.
RANKED = ("North", "South", "Jerusalem", "Abroad")
CENTER = len(RANKED)
#: Between fragments.
SEPARATOR = r"[,/|;•·&\n]|\band\b"
#: Between words: all but letters, digits and apostrophes.
GAP = r"[^\p{L}\p{N}']+"
#: Hebrew letters that are written together with the word behind them (fixed values).
PREFIXES = "ובלמשהכ"


def folded(c: ColumnLike) -> Column:
    """Lower case with one kind of apostrophe."""
    return F.translate(F.lower(text(c)), "’׳`´", "''''")


def words(c: Column) -> Column:
    return F.filter(F.split(c, GAP), lambda w: w != "")


def place_names(places: DataFrame) -> DataFrame:
    """``name, n, rank``: each spelling of a place as words, how many, and the rank of its region."""
    rank = F.array_position(F.array(*map(F.lit, RANKED)), F.col("region"))
    each = places.filter(rank > 0).select((rank - 1).cast("int").alias("rank"), F.explode(F.array("name_en", "name_he")).alias("x")).select("rank", words(folded("x")).alias("ws")).filter("size(ws) > 0")
    return each.groupBy(F.array_join("ws", " ").alias("name"), F.size("ws").alias("n")).agg(F.min("rank").alias("rank"))


def regions(locations: DataFrame, places: DataFrame, longest: int = 4, r: Rules = RULES) -> DataFrame:
    """``loc, region`` of the distinct ``loc`` of ``locations`` (one column, null left out).

    ``longest`` is the number of words of the longest place name that is looked up.
    """
    distinct = locations.select(F.col(locations.columns[0]).alias("loc")).filter("loc is not null").distinct()
    part = distinct.select("loc", F.posexplode(F.split(folded("loc"), SEPARATOR)).alias("i", "part")).select("loc", "i", "part", words(F.col("part")).alias("ws")).filter("size(ws) > 0")
    # what a fragment says beside brackets and ways of working; nothing, or a word for anywhere, names no place
    bare = F.array_join(F.filter(words(F.regexp_replace("part", r"\([^)]*\)", " ")), lambda w: ~w.isin(*r.ways_of_working)), " ")
    blank = (bare == "") | bare.isin(*r.generic_places) | bare.rlike(r"^\d+ (?:more )?locations?$")
    part = part.filter(~blank).select("loc", "i", "ws")
    starts = F.sequence(F.lit(1), F.size("ws"))
    runs = F.flatten(F.transform(starts, lambda a: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("ws") - a + 1)), lambda n: F.array_join(F.slice("ws", a, n), " "))))
    bared = F.filter(F.flatten(F.transform(runs, lambda x: F.array(*(F.when(x.rlike(f"^[{PREFIXES}]{{{k}}}[א-ת]{{2}}"), F.substring(x, F.lit(k + 1), F.length(x))) for k in (1, 2))))), lambda x: x.isNotNull())
    looked = part.select("loc", "i", F.explode(F.array_distinct(F.concat(runs, bared))).alias("name"))
    named = looked.join(place_names(places), "name").groupBy("loc", "i").agg(F.min("rank").alias("rank"))
    bits = part.select("loc", "i").join(named, ["loc", "i"], "left").groupBy("loc").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.coalesce("rank", F.lit(CENTER)))).alias("bits"))
    return distinct.join(bits, "loc", "left").select("loc", decided(F.coalesce("bits", F.lit(0)), F.lower("loc").rlike("israel|ישראל")).alias("region"))


def decided(bits: Column, at_home: Column) -> Column:
    """The region of a set of regions: every set of five is looked up in a table made by the rule."""

    def rule(have: set[str]) -> str:
        if not have:
            return "Unknown"
        if "North" in have:
            return "North"
        if "Center" in have:
            return "Center"
        near = have - {"Abroad"}
        if not near:
            return "Abroad"
        return "Jerusalem" if near == {"Jerusalem"} else "South"

    names = (*RANKED, "Center")
    table = [rule({n for i, n in enumerate(names) if k >> i & 1}) for k in range(1 << len(names))]
    region = F.get(F.array(*map(F.lit, table)), bits)
    # a foreign place beside the name of the country says nothing
    return F.when((region == "Abroad") & at_home, "Unknown").otherwise(region)


def with_region(rows: DataFrame, loc: str, places: DataFrame, out: str = "region", r: Rules = RULES) -> DataFrame:
    """``rows`` with the region of column ``loc``; only distinct locations are looked up. Missing is Unknown."""
    found = regions(rows.select(loc), places, r=r).select(F.col("loc").alias("_loc"), F.col("region").alias("_region"))
    return rows.join(found, F.col(loc) == F.col("_loc"), "left").withColumn(out, F.coalesce("_region", F.lit("Unknown"))).drop("_loc", "_region")


def effective_region(stored: ColumnLike, derived: ColumnLike) -> Column:
    """The stored region, unless it says little and the derived one is specific."""
    return F.when(text(stored).isin("", "Unknown", "Center") & col(derived).isin(*RANKED), col(derived)).otherwise(text(stored))
