"""The curation overlay as a whole, and what a run keeps, shows and sends of its rows.

All maps of an overlay are keyed by normalised link. They become one table with a struct for each
map, so the page is joined with it twice, by its own link and by the links of its copies, however
many maps there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import best_category
from ..functions.rules import RULES, Rules
from ..functions.text import company_from_host, company_is, has, has_word, host, text, title_key, url_norm
from .classify import is_foundation, is_senior, is_student
from .overlay import first_rule
from .relational import first_per_key

#: Fields of the maps; every map has a key ``k`` once.
MAPS = {
    "verdicts": "verdict string, why string, score int", "feed": "company string, role string, region string, loc string, verdict string, why string, score int", "rescued": "company string, role string, region string, loc string, verdict string, why string, score int",
    "origin": "employer string, direct_url string", "pins": "note string, company string, role string, region string, loc string", "ready": "base string, employer string, region string", "reviewed": "ok boolean",
    "outsourced": "label string", "clients": "client string, client_url string", "statuses": "status string",
}
#: Employers that are hidden, and marks that keep a row whatever its verdict says (fixed values).
MASK, KEPT_STATUS = "(masked)", ("Sent", "Interview")
#: Scores of injected rows without one, and how well a verdict fits (fixed values).
NO_SCORE, FITS = 60, {"YES": 5, "REACH": 4}


def entries(maps: dict[str, DataFrame]) -> DataFrame:
    """``k`` and one struct for each of MAPS, null where the map does not have the key."""
    fields = {n: [x.split()[0] for x in ddl.split(", ")] for n, ddl in MAPS.items()}
    types = {n: "struct<" + ddl.replace(" ", ":").replace(",:", ",") + ">" for n, ddl in MAPS.items()}
    parts = [m.select("k", *(F.struct(*fields[n]).cast(types[n]).alias(n) if n == name else F.lit(None).cast(types[n]).alias(n) for n in MAPS)) for name, m in maps.items()]
    every = reduce(lambda a, b: a.unionByName(b), parts).filter("k <> ''")
    return every.groupBy("k").agg(*(F.first(n, ignorenulls=True).alias(n) for n in MAPS))


def injected(page: DataFrame, table: DataFrame, r: Rules = RULES) -> DataFrame:
    """Curated links that neither a row nor a copy on the page has: of the feed, else rescued, else pinned.

    The verdict map comes first: its NO is a tombstone, and a dropped region stays out as well,
    unless the link was sent or interviewed; a pinned link comes in over both.
    """
    no_dups = F.expr("cast(array() as array<string>)")
    have = page.select(F.explode(F.concat(F.array("url"), F.coalesce("dups.url", no_dups))).alias("u")).select(url_norm("u").alias("k")).filter("k <> ''").distinct()
    new = table.filter("feed is not null or rescued is not null or pins is not null").join(have, "k", "left_anti")
    marked = F.coalesce(F.col("statuses.status").isin(*KEPT_STATUS), F.lit(False))

    def may(layer: str) -> Column:
        said = F.coalesce("verdicts.verdict", f"{layer}.verdict")
        return F.col(layer).isNotNull() & (marked | ~(F.upper(text(said)) == "NO") & ~text(f"{layer}.region").isin(*r.drop_regions))

    def row(layer: str) -> Column:
        own = lambda c: text(f"{layer}.{c}")
        said = F.when(F.col("verdicts").isNotNull(), F.col("verdicts.verdict"))
        score = F.col("verdicts.score")
        if layer != "pins":
            said = F.when(F.col("verdicts").isNotNull(), F.col("verdicts.verdict")).otherwise(F.col(f"{layer}.verdict"))
            score = F.coalesce(score, F.col(f"{layer}.score"))
        fit = F.lit(5) if layer == "pins" else reduce(lambda a, v: a.when(F.upper(text(said)) == v, FITS[v]), FITS, F.when(F.lit(False), 0)).otherwise(4)
        region = F.when(own("region") == "", "Unknown").otherwise(own("region"))
        return F.struct(own("company").alias("company"), own("role").alias("role"), own("loc").alias("loc"), region.alias("region"), text(said).alias("verdict"), F.coalesce(score, F.lit(NO_SCORE)).alias("match"), fit.alias("fit"), F.lit(layer).alias("src"))

    pick = F.when(may("feed"), row("feed")).when(may("rescued"), row("rescued")).when(F.col("pins").isNotNull(), row("pins"))
    return new.select("k", pick.alias("x")).filter("x is not null").select(F.col("k").alias("url"), "x.*")


def apply_curation(page: DataFrame, maps: dict[str, DataFrame], key: str = "row_id", r: Rules = RULES) -> DataFrame:
    """The page under its overlay, in this order: inject, verdict, feed mark, entry's fields, origin, label, review mark,
    pin, readiness (which unmasks), company from the host, company flags, outsourcing, client link.

    ``page``: key, url, company, role, loc, region, verdict, match, fit, src, dups. An injected row
    has a null key and follows its entry; a scanned row only has its blanks, its masked employer or
    its unknown region filled. Of pin and readiness the row's own link counts before those of its
    copies, in their order; a review mark counts from any.
    """
    table = entries(maps)
    cols = [key, "url", "company", "role", "loc", "region", "verdict", "match", "fit", "src", "dups"]
    new = injected(page, table, r).withColumn(key, F.lit(None).cast(dict(page.dtypes)[key])).withColumn("dups", F.lit(None).cast(dict(page.dtypes)["dups"]))
    rows = page.select(*cols).unionByName(new.select(*cols)).withColumn("k", url_norm("url"))
    x = rows.join(table, "k", "left")
    # of copies: first pin and readiness by place in the list, any review
    copies = page.select(key, F.posexplode("dups").alias("i", "d")).select(key, "i", url_norm("d.url").alias("k")).filter("k <> ''")
    of_copies = copies.join(table.select("k", "pins", "ready", "reviewed"), "k").groupBy(key).agg(
        *(F.min_by(n, F.when(F.col(n).isNotNull(), F.col("i"))).alias(f"_{n}") for n in ("pins", "ready")), F.max(F.col("reviewed.ok")).alias("_ok")
    )
    x = x.join(of_copies, key, "left")
    said = F.coalesce("verdicts", *(F.when(F.col(n).isNotNull(), F.struct(F.col(f"{n}.verdict").alias("verdict"), F.col(f"{n}.why").alias("why"), F.col(f"{n}.score").alias("score"))) for n in ("feed", "rescued")))
    x = x.withColumn("_v", said)
    x = x.withColumns({"verdict": F.when(F.col("_v").isNotNull(), text("_v.verdict")).otherwise(F.col("verdict")), "match": F.coalesce("_v.score", "match"), "why": text("_v.why"), "from_feed": F.col("feed").isNotNull()})
    # the entry's own fields
    curated = F.col("src").isin("feed", "rescued")
    meta = F.coalesce("feed", "rescued")
    fills = {}
    for c in ("company", "role", "region", "loc"):
        given, have = F.trim(text(meta[c])), F.trim(text(c))
        tells = (given != "") & (given != MASK if c == "company" else F.lit(True)) & ((given != "Unknown") | curated if c == "region" else F.lit(True))
        blank = (have == "") | (have == MASK) | ((have == "Unknown") if c == "region" else F.lit(False))
        takes = curated if c == "loc" else curated | blank
        fills[c] = F.when(meta.isNotNull() & tells & takes, given).otherwise(F.col(c))
    x = x.withColumns(fills)
    # the employer behind a reposted row
    emp = F.trim(text("origin.employer"))
    moved = (emp != "") & (emp != F.trim(text("company")))
    x = x.withColumns({"company_listed": F.when(moved, text("company")), "orig": F.nullif(text("origin.direct_url"), F.lit(""))}).withColumn("company", F.when(moved, emp).otherwise(F.col("company")))
    ready = F.coalesce("ready", "_ready")
    x = x.withColumns(
        {
            "label": best_category("role", r.categories), "gpt_reviewed": F.coalesce(F.col("reviewed.ok"), F.lit(False)) | F.coalesce("_ok", F.lit(False)),
            "pin": F.when(F.coalesce("pins", "_pins").isNotNull(), F.coalesce(F.nullif(F.coalesce("pins", "_pins")["note"], F.lit("")), F.lit("important"))),
            "tailor_ready": ready.isNotNull(), "company": F.when(text("company").isin("", MASK) & (text(ready["employer"]) != ""), ready["employer"]).otherwise(F.col("company")),
            "region": F.when(text("region").isin("", "Unknown") & (text(ready["region"]) != ""), ready["region"]).otherwise(F.col("region")),
        }
    )
    hosted = company_from_host("url", boards=r.boards)
    x = x.withColumn("company", F.when(F.trim(text("company")) != "", F.col("company")).when(hosted != "", hosted).otherwise(MASK))
    names = F.concat_ws(" | ", "company", "company_listed")
    x = x.withColumn("_n", names).withColumns({"referral": company_is("company", r.referral), "outsourced_as": F.coalesce("outsourced.label", first_rule(x, "_n", list(r.company_rules)))})
    x = x.withColumns({"giant": F.col("referral") | company_is("company", r.giants), "client": F.col("clients.client"), "client_url": F.col("clients.client_url")})
    return x.select(*cols[:-1], "why", "from_feed", "company_listed", "orig", "label", "gpt_reviewed", "pin", "tailor_ready", "referral", "giant", "outsourced_as", "client", "client_url")


def kept_rows(rows: DataFrame, statuses: DataFrame, dead_hosts: tuple[str, ...] = (), no_job: str = "") -> DataFrame:
    """Rows that stay: no NO, no dead host, no link that is no job - unless sent, interviewed or pinned."""
    marked = rows.withColumn("k", url_norm("url")).join(statuses.select("k", "status"), "k", "left")
    kept = F.col("status").isin(*KEPT_STATUS) | F.coalesce("important", F.lit(False))
    gone = (F.upper(text("verdict")) == "NO") | (host("url").isin(*dead_hosts) if dead_hosts else F.lit(False)) | (text("url").rlike(no_job) if no_job else F.lit(False))
    return marked.filter(F.coalesce(kept, F.lit(False)) | ~gone).drop("k", "status")


def imported(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """``k, v, fate`` of a local map (k, v) after an import: a local value stays, ``New`` never comes in.

    ``fate``: local, imported, same or kept (the incoming value conflicts and loses).
    """
    both = local.select("k", F.col("v").alias("a")).join(incoming.filter("coalesce(v, '') not in ('', 'New')").select("k", F.col("v").alias("b")), "k", "full_outer")
    own = ~text("a").isin("", "New")
    fate = F.when(F.col("b").isNull(), "local").when(~own, "imported").when(F.col("a") == F.col("b"), "same").otherwise("kept")
    return both.select("k", F.when(F.col("b").isNull() | own, F.col("a")).otherwise(F.col("b")).alias("v"), fate.alias("fate"))


def not_handled(items: DataFrame, judged: DataFrame) -> DataFrame:
    """Digest items (url, company, role) of which neither the link nor company and title are among the judged rows."""
    name = F.concat_ws("|", title_key("company"), title_key("role"))
    x = items.withColumn("_k", url_norm("url")).withColumn("_t", name)
    links = judged.select(url_norm("url").alias("_k")).filter("_k <> ''").distinct()
    titles = judged.select(name.alias("_t")).distinct()
    return x.join(links, "_k", "left_anti").join(titles, "_t", "left_anti").drop("_k", "_t")


def digest_fit(title: str, desc: str, r: Rules = RULES) -> Column:
    """A title that missed the gate and may still be worth a word: a role of the trade, not ruled out by any other list."""
    low = F.lower(text(title))
    for said, meant in r.digest_reads:
        low = F.replace(low, F.lit(said), F.lit(meant))
    role = has_word(title, r.digest_roles) | has(title, r.digest_roles_he)
    return role & ~(is_senior(title, r) | is_student(title, r) | is_foundation(title, desc, r) | has_word(low, r.digest_skip) | has_word(title, r.industrial) | has(title, r.bench_test))


def alerts_today(issues: DataFrame, sent: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """(issues not yet told on ``day``, the day's keys after the run). ``issues`` has source and state; ``sent`` day and key."""
    keyed = issues.filter("state <> 'ok'").withColumn("key", F.concat_ws(":", "source", "state"))
    today = sent.filter(F.col("day") == day).select("key").distinct()
    new = keyed.join(today, "key", "left_anti")
    return new, today.unionByName(new.select("key").distinct()).select(F.lit(day).alias("day"), "key")


def staleness(last_scan: Column, now: str, hours: int = 6) -> Column:
    """struct<hours, stale>: how old the last scan is, and whether that is too old; no scan is stale."""
    age = F.floor((F.unix_timestamp(F.lit(now)) - F.unix_timestamp(last_scan)) / 3600).cast("int")
    old = F.unix_timestamp(F.lit(now)) - F.unix_timestamp(last_scan) > hours * 3600
    return F.struct(age.alias("hours"), F.coalesce(old, F.lit(True)).alias("stale"))


def tracker_rows(roles: DataFrame, day: str) -> DataFrame:
    """Rows of the tracker from merged roles (ord, company, title, region, city, url, sources, lane, tailor, referral, giant).

    ``id`` is made of the day, the family of the first source and the place in the run; sources are
    joined in order; a hidden employer is written so; ``alert``: a known employer's row to act on.
    """
    family = F.substring_index(F.get("sources", F.lit(0)), ":", 1)
    # places are counted within a family; a run's fresh rows are bounded by what one scan finds new
    no = F.row_number().over(Window.partitionBy(family).orderBy("ord")) - 1
    return roles.select(
        "ord", F.concat_ws("-", F.lit("auto"), F.lit(day), family, no.cast("string")).alias("id"), F.when(text("company") == "", MASK).otherwise(F.col("company")).alias("company"), F.col("title").alias("role"), "region", F.col("city").alias("loc"), "url",
        F.array_join(F.array_sort(F.array_distinct("sources")), "+").alias("src"), ((F.col("referral") | F.col("giant")) & ((F.col("lane") == "apply") | F.col("tailor"))).alias("alert"),
    )


def message_line(company: str = "company", role: str = "role", region: str = "region", url: str = "url") -> Column:
    """One entry of a message; fields are cut to what a line holds (fixed values 30, 70, 400)."""
    cut = lambda c, n: F.left(text(c), F.lit(n))
    return F.concat(F.lit("• "), cut(company, 30), F.lit(" — "), cut(role, 70), F.lit(" ["), F.when(text(region) == "", "?").otherwise(F.col(region)), F.lit("]\n"), cut(url, 400))


def digest_lines(items: DataFrame, header: int, budget: int = 3_800, most: int = 12) -> DataFrame:
    """The lines of one digest: unknown regions last, as many as fit behind a header of ``header`` characters, the first always.

    Only the ``most`` first rows are numbered and summed up; what does not fit waits for the next run.
    """
    unknown = (F.when(text("region") == "", "Unknown").otherwise(F.col("region")) == "Unknown").cast("int")
    head = items.withColumn("_u", unknown).orderBy("_u", "ord").limit(most).withColumn("line", message_line())
    w = Window.orderBy("_u", "ord")
    head = head.withColumn("rn", F.row_number().over(w)).withColumn("used", F.lit(header) + F.sum(1 + F.length("line")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return head.filter((F.col("rn") == 1) | (F.col("used") <= budget)).drop("_u")


def digest_memory(memory: DataFrame, told: DataFrame, day: str) -> DataFrame:
    """The memory (k, seen) after a digest was delivered or refused for good: three keys of each item told, the newest day of a key."""
    t = F.concat(F.lit("t:"), F.col("title_key"), F.lit("|"))
    keys = F.array(F.concat(F.lit("u:"), url_norm("url")), F.concat(t, F.col("region")), F.concat(t, F.lit("*")))
    new = told.select(F.explode(keys).alias("k"), F.lit(day).alias("seen"))
    return memory.select("k", "seen").unionByName(new).groupBy("k").agg(F.max("seen").alias("seen"))


def registered_members(members: DataFrame, seen: DataFrame, day: str) -> DataFrame:
    """The permanent ids (id, seen) with those of admitted rows, each only if it is not there yet."""
    new = first_per_key(members.select("id", "ord"), F.col("id"), [F.col("ord")]).select("id", F.lit(day).alias("seen"))
    return seen.select("id", "seen").unionByName(new.join(seen.select("id"), "id", "left_anti"))


def retry_after(queue: DataFrame, delivered: bool, streak: int, least: int = 3) -> tuple[int, bool]:
    """(streak of failed deliveries, whether to end the run with an error) after a run with something to send."""
    if delivered or queue.limit(1).isEmpty():
        return (0 if delivered else streak), False
    return streak + 1, streak + 1 >= least
