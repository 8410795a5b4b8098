"""Curation overlays: precedence joins, injection of missing rows, disagreement, page queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.region import PREFIXES
from ..functions.text import company_is, has_word, is_board, quoted, text, url_norm

#: Order of verdicts, and the band of scores of each (fixed values).
VERDICT_RANK = {"YES": 3, "REACH": 2, "NO": 1}
BANDS = {"YES": (70, 97), "REACH": (45, 69), "NO": (15, 44)}


def rank_of(c: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for v, n in VERDICT_RANK.items():
        out = out.when(c == v, n)
    return out.otherwise(0)


def norm_map(entries: DataFrame) -> DataFrame:
    """One entry for each link: best verdict, then most filled of company and role, then first.

    ``entries``: ord, url, verdict, match, company, role.
    """
    filled = (text("company") != "").cast("int") + (text("role") != "").cast("int")
    keyed = entries.withColumn("k", url_norm("url")).filter("k <> ''")
    best = F.max_by(F.struct("verdict", "match", "company", "role", "url"), F.struct(rank_of(F.col("verdict")), filled, -F.col("ord")))
    return keyed.groupBy("k").agg(best.alias("b"), F.count("*").alias("n")).select("k", "b.verdict", "b.match", "b.company", "b.role", "n")


def norm_values(entries: DataFrame) -> DataFrame:
    """``k, v``: the first value that says something, else the last one."""
    keyed = entries.withColumn("k", url_norm("url")).filter("k <> ''")
    says = ~text("v").isin("", "New")
    return keyed.groupBy("k").agg(F.coalesce(F.min_by(F.when(says, F.col("v")), F.when(says, F.col("ord"))), F.max_by(text("v"), "ord")).alias("v"))


def overlay(rows: DataFrame, maps: list[tuple[str, DataFrame]]) -> DataFrame:
    """The entry of the first map that has the row's link, taken whole, with the map's name."""
    out = rows.withColumn("k", url_norm("url"))
    for name, m in maps:
        out = out.join(m.select("k", F.struct(F.lit(name).alias("layer"), "verdict", "match").alias(f"_{name}")), "k", "left")
    return out.withColumn("o", F.coalesce(*(F.col(f"_{name}") for name, _ in maps))).drop("k", *(f"_{name}" for name, _ in maps))


def inject_missing(page: DataFrame, curated: DataFrame, keep_regions: tuple[str, ...]) -> DataFrame:
    """Curated entries (ord, url, region, verdict, status) whose link no page row or copy has.

    A NO entry or a dropped region stays out unless it was sent or interviewed.
    """
    have = page.select(F.explode(F.concat(F.array("url"), F.coalesce("dups.url", F.expr("array()").cast("array<string>")))).alias("u")).select(url_norm("u").alias("k")).filter("k <> ''").distinct()
    marked = text("status").isin("Sent", "Interview")
    wanted = marked | (~(text("verdict") == "NO") & F.col("region").isin(*keep_regions))
    once = Window.partitionBy("k").orderBy("ord")
    return curated.withColumn("k", url_norm("url")).filter("k <> ''").filter(wanted).join(have, "k", "left_anti").withColumn("_rn", F.row_number().over(once)).filter("_rn = 1").drop("_rn")


def divergent(maps: list[tuple[str, DataFrame]]) -> DataFrame:
    """Links whose verdict differs among the maps that have them."""
    tagged = None
    for name, m in maps:
        x = m.select("k", "verdict", F.lit(name).alias("layer")).filter("verdict is not null and verdict <> ''")
        tagged = x if tagged is None else tagged.unionByName(x)
    return tagged.groupBy("k").agg(F.count_distinct("verdict").alias("n"), F.array_join(F.array_sort(F.collect_set(F.concat("layer", F.lit("="), "verdict"))), ",").alias("votes")).filter("n > 1")


def array_key_lookup(rows: DataFrame, entries: DataFrame, value: str) -> DataFrame:
    """The entry of the row's own link, else of its first copy in list order."""
    own = F.array(F.struct(F.lit(0).alias("pos"), url_norm("url").alias("k")))
    copies = F.transform(F.coalesce("dups", F.expr("array()").cast("array<struct<url:string,src:string,region:string>>")), lambda d, i: F.struct((i + 1).alias("pos"), url_norm(d["url"]).alias("k")))
    keys = rows.select("row_id", F.explode(F.concat(own, copies)).alias("x")).select("row_id", "x.pos", "x.k").filter("k <> ''")
    found = keys.join(entries.select("k", value), "k").groupBy("row_id").agg(F.min_by(value, "pos").alias(value), F.min("pos").alias("pos"))
    return rows.join(found, "row_id", "left")


def first_rule(rows: DataFrame, company: str, rules: list[tuple[str, tuple[str, ...]]]) -> Column:
    """Label of the first company rule that matches; null if none."""
    out = F.when(F.lit(False), F.lit(""))
    for label, names in rules:
        out = out.when(company_is(company, names), label)
    return out


def masked_unique(rows: DataFrame, title: Column, distinctive: Column, masked: Column) -> DataFrame:
    """``named_company`` of masked rows whose distinctive title belongs to exactly one named company."""
    x = rows.withColumn("_t", title)
    named = x.filter(~masked).groupBy("_t").agg(F.min("company").alias("named_company"), F.count_distinct("company").alias("n")).filter("n = 1").drop("n")
    return x.filter(masked & distinctive).join(named, "_t").drop("_t")


def repick_link(url: str, dups: str, boards: tuple[str, ...]) -> Column:
    """The link to publish: a board link yields to the first copy (by link) that is no board."""
    others = F.array_sort(F.filter(F.coalesce(F.col(f"{dups}.url"), F.expr("array()").cast("array<string>")), lambda u: (F.coalesce(u, F.lit("")) != "") & ~is_board(u, boards)))
    return F.when(is_board(url, boards) & (F.size(others) > 0), F.get(others, F.lit(0))).otherwise(text(url))


def estimated_match(match: str = "match", fit: str = "fit") -> Column:
    """The rating if there is one, else an estimate from the fit (at most 65)."""
    guess = F.when(F.coalesce(F.col(fit), F.lit(0)) == 0, 50).otherwise(F.col(fit) * 18)
    return F.coalesce(F.col(match), F.least(guess, F.lit(65)))


#: Rows of a page; a page query never returns more (fixed value).
PAGE_ROWS = 1_200


def page_filter(q: str = "", date: str | None = None, regions: tuple[str, ...] = (), least_match: int | None = None, verdicts: tuple[str, ...] = (), status: tuple[str, ...] = (), flags: tuple[str, ...] = (), top: bool | None = None, hide_done: bool = False, hide_flags: tuple[str, ...] = ()) -> Column:
    """The conditions of a page query, all optional, joined by "and".

    ``q`` in company or role; pull date; region (missing is Unknown); a match that is rated must
    reach ``least_match``; verdict ("unrated" for none); status; ``flags``: columns that must hold;
    ``top``: a YES of 90 or more (True) or below (False); ``hide_done``: nothing sent, interviewed or
    skipped; ``hide_flags``: columns that must not hold. Pinned rows (``important``) need pass only
    the search text and ``hide_done``.
    """
    says = lambda c: F.coalesce(F.col(c), F.lit(False))
    done = text("status").isin("Sent", "Interview", "Skip") if hide_done or status else None
    keep = F.lit(True)
    if date is not None:
        keep = keep & (F.col("pull_date") == date)
    if regions:
        keep = keep & F.coalesce("region", F.lit("Unknown")).isin(*regions)
    if least_match is not None:
        keep = keep & (F.col("match").isNull() | (F.col("match") >= least_match))
    if verdicts:
        keep = keep & (F.when(text("verdict") == "", "unrated").otherwise(F.col("verdict"))).isin(*verdicts)
    if status:
        keep = keep & F.when(text("status") == "", "New").otherwise(F.col("status")).isin(*status)
    if top is not None:
        yes = text("verdict") == "YES"
        keep = keep & yes & ((F.coalesce("match", F.lit(0)) >= 90) if top else (F.coalesce("match", F.lit(0)) < 90))
    for c in flags:
        keep = keep & says(c)
    for c in hide_flags:
        keep = keep & ~says(c)
    found = F.lower(F.concat_ws(" ", text("company"), text("role"))).contains(q.lower()) if q else F.lit(True)
    return (keep | says("important")) & found & (~done if hide_done else F.lit(True))


#: Columns a page is sorted by.
SORTS = {
    "match": lambda: estimated_match(), "date": lambda: F.col("pull_date"), "company": lambda: F.lower(text("company")), "role": lambda: F.lower(text("role")), "region": lambda: text("region"), "fit": lambda: F.coalesce("fit", F.lit(0)),
    "flags": lambda: 2 * F.coalesce("referral", F.lit(False)).cast("int") + F.coalesce("giant", F.lit(False)).cast("int"),
}


def page_query(rows: DataFrame, sort: str = "match", ascending: bool = False, important_first: bool = True, most: int = PAGE_ROWS, **conditions) -> DataFrame:
    """Rows that pass :func:`page_filter`, ranked: pinned ones first, then by a column of SORTS.

    A page is the ``most`` first of them, a top-k; only these are numbered.
    """
    pinned = F.coalesce("important", F.lit(False))
    key = SORTS[sort]()
    order = [*([pinned.desc()] if important_first else []), key.asc() if ascending else key.desc(), F.col("row_id")]
    page = rows.filter(page_filter(**conditions)).orderBy(*order).limit(most)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def band_ok(verdict: str = "verdict", match: str = "match") -> Column:
    """The score lies in the band of its verdict (rows without one pass)."""
    out = F.lit(True)
    for v, (lo, hi) in BANDS.items():
        out = F.when((F.col(verdict) == v) & F.col(match).isNotNull(), F.col(match).between(lo, hi)).otherwise(out)
    return out


def names_any(c: Column, banned: tuple[str, ...]) -> Column:
    """Any of the names as a whole word; a Hebrew name also behind one or two prefix letters."""
    latin, hebrew = [b for b in banned if not re.search("[א-ת]", b)], [b for b in banned if re.search("[א-ת]", b)]
    out = has_word(c, latin) if latin else F.lit(False)
    return out | F.lower(c).rlike(rf"(?<![א-ת])[{PREFIXES}]{{0,2}}(?:{quoted(hebrew)})(?![א-ת])") if hebrew else out


def sanitized(rows: DataFrame, keep: list[str], banned: tuple[str, ...], allow_all: bool = False) -> DataFrame:
    """Whitelisted columns of the rows whose text names nobody on the blocklist.

    Without a blocklist publication is refused, unless ``allow_all`` says so.
    """
    if not banned and not allow_all:
        raise ValueError("a blocklist is required")
    clean = rows.filter(~names_any(F.concat_ws(" ", text("company"), text("role"), text("loc")), banned)) if banned else rows
    out = clean.select(*keep)
    if set(out.columns) - set(keep):
        raise AssertionError("a column outside the whitelist would be published")
    return out
