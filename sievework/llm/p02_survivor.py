"""Problem 2: one surviving record for each group of page rows that lead to the same posting.

Groups are the connected components of rows over shared links (``url`` and ``dups[].url``, each
by its canonical posting key). The survivor is built from *bundles* of dependent fields -
identity (row, url, src), employer (company), opening (role), rating (verdict, match), place
(region, loc) - each taken whole from one copy. The identity is the row the rule of the problem
keeps; the other bundles are chosen by branch and bound, which maximises the summed trust of the
chosen copies (then filled fields, then recency) under two functional dependencies across bundles:
``src -> company`` (a board of one employer names it) and ``role -> rating`` (a rating counts for
the opening it was given to, so it must come with that spelling of the role).

Scale: links are reduced to (row, smallest row of the link) before components are found, so a
link held by a third of all rows costs a partial aggregate; components use alternating large-
and small-star steps with checkpoints. Candidates are pre-aggregated in the JVM to one per
bundle and dependency key, and of the roles only those that no other beats in both opening and
rating remain (a Pareto front, by windows that spill), before they reach Python; no group is
collected row by row. One exchange by group serves the windows and the packing.

Defined results: rows without any link stand alone and form no group; missing fields (null or
'') never win against present ones; ties go to the smallest ``row_id``; an unlisted or missing
``src`` is trusted least; repeated rows are copies like others; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import blank_to_null, cut, query_reading
from .links import posting_key

if TYPE_CHECKING:
    import pandas as pd

#: Trust counts down from here; a source that the list does not name counts nothing.
MOST_TRUST = 1_000_000
#: Bundles in the order of the search.
BUNDLES = ("identity", "employer", "opening", "rating", "place")


def link_edges(rows: DataFrame) -> DataFrame:
    """``v, u``: each row and the smallest row that shares one of its links (u < v)."""
    links = rows.select(
        "row_id", F.explode(F.concat(F.array("url"), F.coalesce(F.col("dups.url"), F.expr("array()").cast("array<string>")))).alias("url")
    ).select("row_id", posting_key(F.col("url")).alias("key")).filter("key is not null").distinct()
    first = links.groupBy("key").agg(F.min("row_id").alias("u"), F.count("*").alias("n")).filter("n > 1")
    return links.join(first, "key").select(F.col("row_id").alias("v"), "u").filter("u < v").distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``id, root``: the smallest node of each component, for every node of ``edges`` (v, u).

    Alternates large-star (every larger neighbour of a node is linked to the node's smallest
    neighbour) and small-star (a node and its smaller neighbours are linked to the smallest)
    until all edges lead from a node to a root: O(log^2 n) rounds, each cut from its lineage.
    """
    edges = cut(edges)
    for _ in range(max_rounds):
        # settled: no node has two edges, and no end of an edge has one of its own
        open_ends = edges.select(F.col("v").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("m")).union(edges.select("u", F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("n").alias("n"), F.max("m").alias("m"))
        if open_ends.filter("n > 1 or n = 1 and m = 1").limit(1).isEmpty():
            break
        both = edges.select(F.col("v").alias("a"), F.col("u").alias("b")).union(edges.select("u", "v"))
        m = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(m, "a").select(F.col("b").alias("v"), F.col("m").alias("u")).filter("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        linked = large.join(low, "v")
        edges = cut(
            linked.select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u"))).filter("u < v").distinct()
        )
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("id"), F.col("u").alias("root")).union(edges.select("u", "u").distinct())


def org_token(c: Column) -> Column:
    """The first word of a name or board, letters and digits only."""
    return F.nullif(F.regexp_extract(F.regexp_replace(F.lower(c), r"^\s*the\s+", ""), r"([\p{L}\p{N}]+)", 1), F.lit(""))


def role_key(c: Column) -> Column:
    """The words of a role in one order: what a rating was given for; null if missing."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}+#]+", " "), " "), lambda w: w != "")
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(words)), " "), F.lit(""))


def candidates(rows: DataFrame, groups: DataFrame, trust: DataFrame) -> DataFrame:
    """``group_id, bundle, fd, row_id, vals, score``: what may still win; rows of a group lie in one partition."""
    family = F.lower(F.trim(F.regexp_extract(F.coalesce("src", F.lit("")), r"^[^:]*", 0)))
    filled = lambda *cs: sum((F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", 1).otherwise(0) for c in cs), F.lit(0))
    base = (
        rows.join(groups, rows.row_id == groups.id)
        .withColumn("family", family)
        .join(trust.select(F.lower(F.trim("src")).alias("family"), "trust").groupBy("family").agg(F.min("trust").alias("trust")), "family", "left")
        .withColumn("t", F.when(F.col("trust").isNull(), 0).otherwise(F.lit(MOST_TRUST) - F.col("trust")).cast("bigint"))
    )
    text = lambda c: F.coalesce(blank_to_null(F.col(c).cast("string")), F.lit(""))
    # dependency key, values, present fields, usable at all
    bundles = {
        "identity": (org_token(F.regexp_extract("src", r":(.+)$", 1)), ["url", "src"], filled("company", "loc", "region", "verdict", "match"), F.lit(True)),
        "employer": (org_token(F.col("company")), ["company"], filled("company"), filled("company") > 0),
        "opening": (role_key(F.col("role")), ["role"], filled("role"), filled("role") > 0),
        "rating": (role_key(F.col("role")), ["verdict", "match"], filled("verdict", "match"), filled("verdict", "match") > 0),
        "place": (F.lit(None).cast("string"), ["region", "loc"], filled("region", "loc"), filled("region", "loc") > 0),
    }
    at = F.coalesce(F.unix_micros(F.col("pulled_at").cast("timestamp")), F.lit(0).cast("bigint"))
    each = F.array(
        *(
            F.struct(F.lit(BUNDLES.index(b)).alias("bundle"), fd.alias("fd"), F.array(*map(text, cs)).alias("vals"), ok.alias("ok"), F.struct(F.col("t"), n.cast("int").alias("n"), at.alias("at"), (-F.col("row_id")).alias("neg")).alias("score"))
            for b, (fd, cs, n, ok) in bundles.items()
        )
    )
    best = (
        base.select("root", "row_id", F.explode(each).alias("b")).filter("b.ok")
        .groupBy("root", "b.bundle", "b.fd").agg(F.max_by(F.struct("row_id", "b.vals", "b.score"), "b.score").alias("w"))
        .select("root", "bundle", "fd", "w.row_id", "w.vals", "w.score").repartition("root")
    )
    of = lambda i, c="score": F.when(F.col("bundle") == i, F.col(c))
    group, key = Window.partitionBy("root"), Window.partitionBy("root", "fd")
    # a role that another one equals in its opening and beats in its rating, or the other way round, cannot win
    front = Window.partitionBy("root", "bundle").orderBy(F.col("o").desc_nulls_last(), F.col("r").desc_nulls_last(), "fd").rowsBetween(Window.unboundedPreceding, -1)
    seen = best.withColumn("id0", F.max(F.when(F.col("bundle") == 0, F.struct("score", "fd"))).over(group)).withColumn("emp", F.max(of(1)).over(group)).withColumn("o", F.max(of(2)).over(key)).withColumn("r", F.max(of(3)).over(key))
    seen = seen.withColumn("first", F.count(F.lit(1)).over(front) == 0).withColumn("before", F.max("r").over(front))
    return seen.filter(
        F.when(F.col("bundle") == 0, F.col("score") == F.col("id0.score"))
        .when(F.col("bundle") == 1, (F.col("score") == F.col("emp")) | (F.col("fd") == F.col("id0.fd")))
        .when(F.col("bundle").isin(2, 3), F.col("fd").isNull() | F.col("first") | F.coalesce(F.col("r") > F.col("before"), F.col("r").isNotNull() & F.col("before").isNull()))
        .otherwise(True)
    ).select(F.col("root").alias("group_id"), "bundle", "fd", "row_id", "vals", "score")


#: Bundles (earlier, later) whose dependency keys must agree where both are known.
DEPENDS = ((0, 1), (2, 3))


def best_assignment(options: list[list[tuple]]) -> tuple[tuple, int]:
    """(choice of each bundle, branches looked at) by branch and bound.

    ``options[i]`` lists ``(score, fd, row_id, vals)`` of bundle i; None, "leave empty", is always
    possible and scores nothing. Maximises the sum of scores (tuples, compared from the left; the
    order of such sums is kept by adding, so bounds add up). A choice whose dependency key differs
    from that of the bundle it depends on is a dead branch. The bound of a branch is its own sum
    and the best of each open bundle.
    """
    width = max((len(o[0]) for os in options for o in os), default=0)
    add = lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))
    zero = (0,) * width
    ordered = [sorted(os, key=lambda o: o[0], reverse=True) for os in options]
    rest = [zero]
    for os in reversed(ordered):  # what the open bundles could add at most
        rest.append(add(rest[-1], max(os[0][0], zero) if os else zero))
    rest.reverse()
    parent = {b: a for a, b in DEPENDS}
    best, best_sum, looked = (None,) * len(options), None, 0
    stack = [((), zero)]
    while stack:
        chosen, total = stack.pop()
        i = len(chosen)
        if best_sum is not None and add(total, rest[i]) <= best_sum:
            continue
        looked += 1
        if i == len(options):
            best, best_sum = chosen, total
            continue
        stack.append(((*chosen, None), total))
        on = chosen[parent[i]] if i in parent else None
        for o in reversed(ordered[i]):  # the best option is popped first
            if on is None or not on[1] or not o[1] or on[1] == o[1]:
                stack.append(((*chosen, o), add(total, o[0])))
    return best, looked


SURVIVOR = "group_id bigint, row_id bigint, url string, src string, company string, region string, loc string, role string, verdict string, match int, employer_row bigint, place_row bigint"


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pandas as pd  # in the worker only: the driver needs none

    for pdf in batches:
        out = []
        for gid, cands in zip(pdf["group_id"], pdf["cands"], strict=True):
            options: list[list[tuple]] = [[], [], [], [], []]
            for c in cands:
                s = c["score"]
                options[c["bundle"]].append(((s["t"], s["n"], s["at"], s["neg"]), c["fd"], c["row_id"], list(c["vals"])))
            (ident, emp, role, rating, place), _ = best_assignment(options)
            vals = lambda o, n: [v or None for v in o[3]] if o else [None] * n
            out.append((gid, ident[2], *vals(ident, 2), *vals(emp, 1), *vals(place, 2), *vals(role, 1), *vals(rating, 2), emp[2] if emp else None, place[2] if place else None))
        r = pd.DataFrame(out, columns=[x.split()[0] for x in SURVIVOR.split(", ")])
        r["match"] = pd.to_numeric(r["match"]).astype("Int32")
        r["employer_row"], r["place_row"] = r["employer_row"].astype("Int64"), r["place_row"].astype("Int64")
        yield r


def survivors(rows: DataFrame, trust: DataFrame) -> DataFrame:
    """One surviving record for each group of two or more rows; columns it does not read may clash."""
    rows = rows.select("row_id", "company", "role", "loc", "url", "src", "region", "verdict", "match", "pulled_at", "dups")
    groups = components(link_edges(rows))
    cands = candidates(rows, groups, trust)
    packed = cands.groupBy("group_id").agg(F.collect_list(F.struct("bundle", "fd", "row_id", "vals", "score")).alias("cands"))
    return packed.mapInPandas(_build, SURVIVOR)


@query_reading("page_rows", "src_list")
def p2_survivors(rows: DataFrame, src_list: DataFrame) -> DataFrame:
    """The surviving records, field bundles included."""
    return survivors(rows, src_list)


@query_reading("page_rows", "src_list")
def p2_found(rows: DataFrame, src_list: DataFrame) -> DataFrame:
    """Each group and its row to keep: the identity bundle of the survivor."""
    return survivors(rows, src_list).select("group_id", "row_id")


QUERIES = {"p2_found": p2_found, "p2_survivors": p2_survivors}
