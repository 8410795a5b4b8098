"""Collapse copies of one opening on a page: greedy merge around an evolving keeper."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import RULES, Rules
from ..functions.text import text, title_key, url_norm


if TYPE_CHECKING:
    import pandas as pd


def _host(u: str) -> str:
    m = re.match(r"[a-z][a-z0-9+.-]*://([^/:?#]+)", (u or "").strip(" <>\n").lower())
    return m.group(1) if m else ""


def merge_group(rows: list[dict], boards: tuple[str, ...]) -> list[dict]:
    """Rows of one opening key, merged: the best row keeps, rows that point to it are tried first.

    Two rows stay apart if both have an employer's own link, or if neither has one and their known
    regions differ. A keeper takes over links and flags; what is left starts again.
    """
    own = lambda urls: {u for u in urls if u and not any(_host(u) == b or _host(u).endswith("." + b) for b in boards)}
    rank = lambda r: (r["verdict"] == "YES", r["verdict"] == "REACH", bool(own(r["urls"])), bool(r["important"]), r["match"] or 0, len(r["urls"]), -r["row_id"])
    left, out = list(rows), []
    while left:
        keeper = max(left, key=rank)
        rest = sorted((r for r in left if r is not keeper), key=lambda r: (not (set(r["points"]) & set(keeper["urls"])), r["row_id"]))
        keeper = {**keeper, "urls": list(keeper["urls"]), "merged": [keeper["row_id"]]}
        again = []
        for r in rest:
            a, b = own(keeper["urls"]), own(r["urls"])
            known = {keeper["region"], r["region"]} - {"", "Unknown", None}
            traced = set(r["points"]) and not set(r["points"]) & set(keeper["urls"]) and not set(keeper["points"]) & set(r["urls"]) and bool(set(r["points"]) & a)
            if (a and b and not a & b) or (not a and not b and len(known) > 1) or traced:
                again.append(r)
                continue
            keeper["urls"] += [u for u in r["urls"] if u not in keeper["urls"]]
            keeper["important"] = bool(keeper["important"] or r["important"])
            keeper["merged"].append(r["row_id"])
        out.append(keeper)
        left = again
    return out


SCHEMA = "key string, row_id bigint, url string, important boolean, merged array<bigint>, urls array<string>"


def collapse_copies(rows: DataFrame, rules: Rules = RULES) -> DataFrame:
    """One row for each opening among named rows with a telling title (three words or more).

    Rows that agree in all fields the merge reads are folded to the one with the smallest id before
    grouping (``merged`` names folded rows), so copies cost nothing; what a group then holds are the
    distinct links, marks and ratings of one company's title.
    """
    urls = F.filter(F.array_distinct(F.concat(F.array(url_norm("url")), F.transform(F.coalesce("dups.url", F.expr("array()").cast("array<string>")), url_norm))), lambda u: u != "")
    key = F.concat_ws("|", F.get(F.split(title_key("company"), " "), F.lit(0)), title_key("role"))
    x = rows.filter((F.size(F.split(title_key("role"), " ")) >= 3) & (title_key("company") != "")).select(
        key.alias("key"), "row_id", text("url").alias("url"), F.col("important"), text("verdict").alias("verdict"), "match", text("region").alias("region"), urls.alias("urls"),
        F.filter(F.array(url_norm("orig")), lambda u: u != "").alias("points"),
    )
    boards = rules.boards
    # rows that agree in all the merge reads are one row, known by its smallest id
    fields = [c for c in x.columns if c != "row_id"]
    x = x.groupBy(*fields).agg(F.min("row_id").alias("row_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd  # in the worker only: the driver needs none

        for pdf in batches:
            out = []
            for k, rs in zip(pdf["key"], pdf["rs"], strict=True):
                items = [{**r, "urls": list(r["urls"]), "points": list(r["points"])} for r in rs]
                out += [(k, r["row_id"], r["url"], bool(r["important"]), r["merged"], r["urls"]) for r in merge_group(sorted(items, key=lambda r: r["row_id"]), boards)]
            yield pd.DataFrame(out, columns=["key", "row_id", "url", "important", "merged", "urls"])

    packed = x.groupBy("key").agg(F.collect_list(F.struct("row_id", "url", "important", "verdict", "match", "region", "urls", "points")).alias("rs"))
    return packed.mapInPandas(run, SCHEMA)
