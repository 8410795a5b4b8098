"""Problem 5: match records of two tables that share no key.

Method: every row is reduced to partial attributes - employer (a consonant skeleton that both
scripts share), project, level and position, places, linked posting numbers. A position is a known
spelling of a kind of work or, for any other, the words of the title themselves, so titles nobody
listed match as well. MinHash blocking across attributes: a key is two attributes as they are and a
MinHash of the letter pairs of a third (``SIGNATURES`` hash functions), so two rows meet when any
three attributes agree, and also when one of the three is misspelt and the fourth is missing; rows
that name the same posting number meet too. Pairwise similarity features go to a logistic
classifier. Weak labels: a listing that names a posting's number is known in full through that
posting, so its pairs are labelled by full knowledge while their features come from what the
listing itself says; the classifier learns how much partial evidence is enough. Calibration (Platt)
is fitted on a held-out half; the probability alone decides, and is the confidence. A shared number
is evidence of its own: its confidence is the measured share of such pairs that nothing contradicts.

Scale: both tables go through one pass; equal rows are one profile (known by 128 bits) and pairs are
made between profiles and joined with their members at the end, so copies cost nothing in the
search. A profile is sent once to each of its blocks (two attributes) with all that it knows; there
the keys of the block are made and joined in place, and what two profiles have in common is worked
out on the spot, so neither keys nor attributes of pairs are ever shuffled. Pairs are two numbers
and a few bits. Kinds of blocks go one after the other and every step ends in a compressed table,
after which its shuffles are freed, so the disk holds those of one step only. The sort-merge join
of a block's keys grows with the pairs that share one, not with the square of the block; a block is
one task, the largest are those of a title and a place. The classifier is fitted on counts of all
labelled pairs' feature vectors (flags, so few distinct ones); scoring is a JVM expression.

Defined results: a null, empty or masked attribute is unknown and neither joins nor parts; rows
with fewer than two known attributes match only by number; ties are all returned; repeated rows
all count; other columns are ignored; an empty table gives no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, cut, let, query_reading
from .links import posting_key
from .p07_places import named_places, with_copy_region

#: Hash functions for the attribute of a block that may be misspelt.
SIGNATURES = 4
THRESHOLD = 0.5

#: Masked employers (fixed values).
MASKED = {"", "masked", "confidential", "חסוי", "חסויה", "undisclosed", "company", "anonymous"}
#: Words that open or close a company's name without being part of it (fixed values).
COMPANY_NOISE = re.compile(r"^the |\b(?:company|corp|ltd|inc|gmbh|llc)\b\.?|בע[\"״]מ|[-–] ?r&d center|^חברת ")
#: Levels and how they are written (fixed values).
LEVELS = {
    "junior": r"junior|jr|jun|entry[ -]level|מתחיל/?ה?|מתחיל/ה", "senior": r"senior|sr|snr|sen|בכיר/?ה?", "lead": r"team lead|lead|ld|ראש צוות", "leading": r"מוביל/?ה?", "staff": r"staff",
    "principal": r"principal|princ|ראשי/?ת?", "student": r"student|undergrad|intern|סטודנט/?י?ת?",
}
#: A word that may stand for several levels, and what it means where the postings do not tell.
AMBIGUOUS = {"leading": "lead"}
_LEVEL = {k: re.compile(rf"(?<![\w/])(?:{v})(?![\w/])\.?") for k, v in LEVELS.items()}
#: Spellings, short forms and translations of kinds of work, first match wins (fixed values); others stand for themselves.
POSITIONS = {
    "machine learning": r"machine[ -]learning|\bml\b|למידת מכונה", "test automation": r"automation|אוטומציה", "verification": r"verif|ורפיקציה", "site reliability": r"reliab|\bsre\b|אמינות",
    "product analyst": r"analyst|אנליסט", "security": r"secur|cyber|אבטחה", "integration": r"integr|אינטגרציה", "compiler": r"compil|toolchain|מהדרים", "graphics": r"graphic|render|גרפיקה",
    "firmware": r"firmware|\bfw\b|קושחה", "embedded": r"embed|מערכות משובצות", "algorithm": r"algo|אלגוריתמים", "frontend": r"front|\bui\b|צד לקוח", "backend": r"back|server|צד שרת",
    "network": r"netw|רשת", "mobile": r"mobile|מובייל", "data": r"\bdata\b|נתונים", "support": r"support|תמיכה",
}
_POSITION = {k: re.compile(v) for k, v in POSITIONS.items()}
_KEYWORDS = [(w, k) for k, ws in {"machine learning": "machine learning", "test automation": "automation", "verification": "verification", "site reliability": "reliability", "product analyst": "analyst", "security": "security", "integration": "integration", "compiler": "compiler", "graphics": "graphics", "firmware": "firmware", "embedded": "embedded", "algorithm": "algorithm", "frontend": "frontend", "backend": "backend", "network": "network", "mobile": "mobile", "data": "data", "support": "support"}.items() for w in ws.split()]
_TITLE_NOISE = re.compile(r"\[new\]|#\w+|\((?:m/f|m/w/d|f/m)\)|[-–] ?(?:hybrid|full time|remote|part time)\b.*$")
_FRONT = re.compile(r"^([a-z]{4,}): (.+)$")
_BACK = re.compile(r"^(.+?) ?(?:@|,|-|–|\()\s*([a-z]{4,})(?: team)?\)?$")
_BACK_HE = re.compile(r"^(.+?) (?:לצוות|לפרויקט) ([a-z]{4,})$")
_HEBREW = dict(zip("בגדזחטכךלמםנןסעפףצץקרשת", "b g d z h t k k l m m n n s - p p c c k r s t".split(), strict=True))


def skeleton(name: str) -> str:
    """Consonants of a name in a form that Latin and Hebrew spellings share."""
    s = re.sub(r"[^a-zא-ת]", "", name.replace("'", ""))
    if re.search("[א-ת]", s):
        return "".join(_HEBREW.get(c, "") for c in s).replace("-", "").replace("h", "")
    for a, b in (("sh", "s"), ("ch", "k"), ("th", "t"), ("ph", "p"), ("qu", "k"), ("x", "ks"), ("v", "b"), ("w", "b"), ("f", "p"), ("c", "k"), ("q", "k"), ("j", "g")):
        s = s.replace(a, b)
    return re.sub("[aeiouyh]", "", s)


def edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return min(row[-1], most + 1)


def attributes(company: str | None, role: str | None) -> tuple[str | None, str | None, str | None, str, str | None]:
    """(employer skeleton, first word of the employer, project, level, position); None = unknown."""
    c = re.sub(r"\s+", " ", COMPANY_NOISE.sub(" ", (company or "").lower().strip(" ()\t\n"))).strip(" -–.,")
    words = re.split(r"[ -]", c)
    employer, sk = (None, None) if c in MASKED or not words[0] else (words[0], skeleton(words[0]) or None)
    r = re.sub(r"\s+", " ", _TITLE_NOISE.sub(" ", (role or "").lower())).strip(" -–,")
    if not r:
        return sk, employer, None, "none", None
    project = None
    if m := _FRONT.match(r):
        project, r = m.groups()
    elif m := _BACK_HE.match(r) or _BACK.match(r):
        if not any(p.search(m.group(2)) for p in _POSITION.values()):
            r, project = m.groups()
    level = next((k for k, p in _LEVEL.items() if p.search(r)), None)
    if level is None and (ws := r.split()) and len(ws) > 2 and len(ws[0]) > 4:
        level = next((k for k in LEVELS if k not in AMBIGUOUS and edits(ws[0], k, 2) <= (2 if len(k) > 5 else 1)), None)
    position = next((k for k, p in _POSITION.items() if p.search(r)), None)
    if position is None:
        near = min(((edits(w, k, 2), p) for w in re.findall(r"[a-zא-ת]{4,}", r) for k, p in _KEYWORDS), default=(3, None))
        position = near[1] if near[0] <= 2 else open_position(r)
    return sk, employer, project, level or "none", position


def open_position(title: str) -> str | None:
    """What is left of a title that names no listed kind of work: its words without levels, sorted."""
    for p in _LEVEL.values():
        title = p.sub(" ", title)
    return " ".join(sorted(set(re.findall(r"[^\W_]{2,}", title)))) or None


ATTRS = ("sk", "employer", "project", "level", "position")
#: What a profile knows.
KNOWN = (*ATTRS, "places")
_NONE = "cast(array() as array<string>)"


def _attribute_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [attributes(c, r) for c, r in zip(b.column("company").to_pylist(), b.column("role").to_pylist(), strict=True)]
        keep = [b.column(c) for c in ("uid", "links", "numbers")]
        yield pa.RecordBatch.from_arrays([*keep, *(pa.array([o[i] for o in out], pa.string()) for i in range(5))], names=["uid", "links", "numbers", *ATTRS])


def described(page: DataFrame, agency: DataFrame, places: DataFrame) -> DataFrame:
    """Both tables as ``uid`` (2 x id, + 1 for a listing), ``links``, ``numbers``, KNOWN."""
    number = lambda u: F.coalesce(F.regexp_extract_all(u, F.lit(r"(\d{6,})(?!\d)"), 1), F.expr(_NONE))
    urls = F.concat(F.array("url"), F.coalesce("dups.url", F.expr(_NONE)))
    left = page.select(
        (F.col("row_id") * 2).alias("uid"), "company", "role", F.array_distinct(F.filter(F.transform(urls, posting_key), lambda k: k.isNotNull())).alias("links"),
        F.array_distinct(F.flatten(F.transform(urls, number))).alias("numbers"),
    )
    # a listing names the posting it copies in its query or fragment, its own number is in the path
    right = agency.select((F.col("listing_id") * 2 + 1).alias("uid"), "company", "role", F.expr(_NONE).alias("links"), F.array_distinct(number(F.regexp_extract("url", r"[?#](.*)$", 1))).alias("numbers"))
    where = with_copy_region(page).withColumn("row_id", F.col("row_id") * 2).unionByName(agency.select((F.col("listing_id") * 2 + 1).alias("row_id"), "loc", F.lit(None).cast("string").alias("region")))
    named = (
        named_places(where, places).filter("place_id > 0").join(places.select("place_id", "name_en"), "place_id")
        .groupBy(F.col("row_id").alias("uid")).agg(F.array_sort(F.collect_set("name_en")).alias("places"))
    )
    parsed = left.unionByName(right).mapInArrow(_attribute_batches, "uid bigint, links array<string>, numbers array<string>, " + ", ".join(f"{c} string" for c in ATTRS))
    return parsed.join(named, "uid", "left")


def told_levels(rows: DataFrame) -> DataFrame:
    """``rows`` with ambiguous levels replaced by what other rows of the same postings say most often.

    What is counted are pairs of level names, so a few dozen numbers reach the driver.
    """
    said = rows.filter("uid % 2 = 0 and position is not null and level <> 'none'").select(F.explode("links").alias("k"), "level").groupBy("k").agg(F.collect_set("level").alias("ls")).filter("size(ls) > 1")
    pairs = said.select(F.explode("ls").alias("x"), "ls").filter(F.col("x").isin(*AMBIGUOUS)).select("x", F.explode("ls").alias("y")).filter(~F.col("y").isin(*AMBIGUOUS))
    best = {r.x: r.y for r in pairs.groupBy("x", "y").count().groupBy("x").agg(F.max_by("y", F.struct("count", "y")).alias("y")).collect()}
    level = F.col("level")
    for word, default in AMBIGUOUS.items():
        level = F.when(F.col("level") == word, best.get(word, default)).otherwise(level)
    return rows.withColumn("level", level)


def filled(rows: DataFrame) -> DataFrame:
    """``rows`` with unknown attributes taken from rows of the same posting, and ``own``: what the row itself says.

    Page rows of one posting share a link; a listing shares the number it names.
    """
    keys = F.when(F.col("uid") % 2 == 0, F.concat(F.transform("links", lambda k: F.concat(F.lit("l"), k)), F.transform("numbers", lambda n: F.concat(F.lit("n"), n)))).otherwise(F.transform("numbers", lambda n: F.concat(F.lit("n"), n)))
    level = F.when(F.col("position").isNotNull(), F.col("level"))
    page = F.col("uid") % 2 == 0
    # numbers lead listings to postings only; page rows know each other by the whole link
    known = rows.filter(page).select(F.explode(keys).alias("k"), *KNOWN).groupBy("k").agg(*(F.min(level if c == "level" else c).alias(c) for c in KNOWN), F.count("*").alias("n"))
    lacks = page & (F.col("level") == "none")
    for c in KNOWN:
        lacks = lacks | F.col(c).isNull()
    some = (
        rows.filter(lacks).select("uid", F.explode(keys).alias("k")).filter("uid % 2 = 1 or k like 'l%'").join(known.filter("n > 1 or k like 'n%'"), "k")
        .groupBy("uid").agg(*(F.min(c).alias(f"_{c}") for c in KNOWN))
    )
    own = F.struct(*KNOWN).alias("own")
    told = F.when(F.col("position").isNull() | page & (F.col("level") == "none"), F.coalesce("_level", "level")).otherwise(F.col("level"))
    both = rows.filter(lacks).join(some, "uid", "left").select("uid", "numbers", own, *(told.alias("level") if c == "level" else F.coalesce(c, f"_{c}").alias(c) for c in KNOWN))
    # the others have nothing to be filled and stay where they are
    return rows.filter(~lacks).select("uid", "numbers", own, *KNOWN).unionByName(both)


def signatures(c: Column) -> Column:
    """MinHash values of the letter pairs of a word, one for each hash function; null for null."""
    word = F.concat(F.lit("^"), c, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.xxhash64(F.substring(word, i, F.lit(2))))
    return F.when(c.isNotNull(), let(pairs, lambda ps: F.transform(F.sequence(F.lit(1), F.lit(SIGNATURES)), lambda s: F.array_min(F.transform(ps, lambda p: F.xxhash64(p, s))))))


def title() -> Column:
    """Level and position as one attribute; null where the position is unknown."""
    return F.when(F.col("position").isNotNull(), F.concat_ws("/", "level", "position"))


#: Kinds of blocks: the two attributes of a block (c employer, p project, t title, o place), the one by whose MinHash its
#: rows meet, and whether they also meet by place. The last is a posting number.
KINDS = (("ct", "p", True), ("pt", "c", False), ("cp", "t", True), ("to", "p", False), ("po", "t", False), ("#", "", False))


def blocks(kind: int) -> Column:
    """Blocks of that kind that a profile is in, as array<bigint>."""
    two, none = KINDS[kind][0], F.expr("cast(array() as array<bigint>)")
    if two == "#":
        return F.coalesce(F.transform("numbers", lambda n: F.xxhash64(F.lit("#"), n)), none)
    exact = {"c": F.col("sk"), "p": F.col("project"), "t": title()}
    x, y = exact[two[0]], exact.get(two[1])
    if y is None:  # no employer needed
        return F.when(x.isNotNull() & F.col("places").isNotNull(), F.transform("places", lambda o: F.xxhash64(F.lit(kind), x, o))).otherwise(none)
    return F.when(x.isNotNull() & y.isNotNull(), F.array(F.xxhash64(F.lit(kind), x, y))).otherwise(none)


def keys_in(kind: int, about: dict[str, Column]) -> Column:
    """Keys by which a profile meets others of its block, as array<bigint>; ``about``: MinHash values by attribute."""
    two, third, by_place = KINDS[kind]
    if two == "#":
        return F.expr("array(0L)")
    none = F.expr("cast(array() as array<bigint>)")
    out = F.coalesce(F.transform(about[third], lambda m, j: F.xxhash64(j, m)), none)
    return F.concat(out, F.coalesce(F.transform("places", lambda o: F.xxhash64(F.lit("o"), o)), none)) if by_place else out


def block_keys() -> Column:
    """Every key of a profile, whatever its block: a posting number, or three attributes of which one may be a MinHash."""
    about = {"c": F.col("_sk"), "p": F.col("_project"), "t": F.col("_title")}
    one = lambda kind: F.flatten(F.transform(blocks(kind), lambda k: F.transform(keys_in(kind, about), lambda m: F.xxhash64(k, m))))
    return F.array_distinct(F.concat(*(one(kind) for kind in range(len(KINDS)))))


def tagged(rows: DataFrame) -> DataFrame:
    """``rows`` and ``h``, which equal rows of a side share; what a listing itself says only where it names a number."""
    side = (F.col("uid") % 2).cast("int")
    numbered = (side == 1) & (F.size("numbers") > 0)
    rows = rows.withColumns({"numbers": F.array_sort("numbers"), "own": F.when(numbered, F.col("own"))})
    told = F.to_json(F.struct(side.alias("side"), *KNOWN, "own", F.when(numbered, F.col("numbers")).alias("numbers")))
    return rows.withColumn("h", F.unhex(F.md5(told)))


def profiles(tagged: DataFrame) -> DataFrame:
    """``pid`` (the smallest ``uid``), ``h``, ``side``, ``own``, ``numbers``, KNOWN of each profile."""
    # a page profile names every number of its rows; each number is a key of its own
    one = tagged.groupBy("h").agg(F.min("uid").alias("pid"), F.first(F.struct("own", *KNOWN)).alias("f"), F.array_distinct(F.flatten(F.collect_set("numbers"))).alias("numbers"))
    return one.select("pid", "h", (F.col("pid") % 2).cast("int").alias("side"), "f.own", "numbers", *(f"f.{c}" for c in KNOWN))


FEATURES = ["employer_same", "employer_near", "employer_diff", "project_same", "project_near", "project_diff", "position_same", "position_near", "position_diff", "level_diff", "level_lost", "place_same", "place_diff"]
#: What parts two openings that are known in full.
DIFF = ("employer_diff", "project_diff", "position_diff", "level_diff", "level_lost", "place_diff")


def features(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Similarity features of pairs with structs ``a`` and ``b`` of KNOWN attributes."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    known = lambda c: x(c).isNotNull() & y(c).isNotNull()
    same = lambda c: x(c) == y(c)
    head = F.least(F.length(x("employer")), F.length(y("employer")))
    glued = (head >= 5) & (x("employer").startswith(y("employer")) | y("employer").startswith(x("employer")))
    emp = F.when(~known("sk"), 0).when(same("sk") | glued, 1).when((F.levenshtein(x("sk"), y("sk")) <= 1) | (F.levenshtein(x("employer"), y("employer")) <= 2), 2).otherwise(3)
    proj = F.when(~known("project"), 0).when(same("project"), 1).when(F.levenshtein(x("project"), y("project")) <= 2, 2).otherwise(3)
    pos = F.when(~known("position"), 0).when(same("position"), 1).when(F.levenshtein(x("position"), y("position")) <= 2, 2).otherwise(3)
    place = F.when(~known("places"), 0).when(F.arrays_overlap(x("places"), y("places")), 1).otherwise(2)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    told = known("position") & (x("level") != "none") & (y("level") != "none")
    kinds = {"employer": emp, "project": proj, "position": pos}
    out = pairs.withColumns({f"_{k}": v for k, v in kinds.items()} | {"_place": place})
    flags = {f"{k}_{n}": flag(F.col(f"_{k}") == i) for k in kinds for i, n in ((1, "same"), (2, "near"), (3, "diff"))}
    flags |= {"level_diff": flag(told & ~same("level")), "level_lost": flag(known("position") & ~told & ~same("level")), "place_same": flag(F.col("_place") == 1), "place_diff": flag(F.col("_place") == 2)}
    return out.withColumns(flags).drop("_employer", "_project", "_position", "_place")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights (bias last) of a ridge-regularised logistic regression over weighted rows, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    n = np.ones(len(x)) if weight is None else weight
    w, pen = np.zeros(a.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (n * p * (1 - p) + 1e-9)) @ a + np.diag(pen), a.T @ (n * (y - p)) - pen * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Weights used where there are no weak labels to learn from (fixed values; order of FEATURES, bias last).
PRIOR = np.array([3.0, 2.0, -6.0, 4.0, 2.0, -6.0, 2.0, 1.0, -5.0, -6.0, -6.0, 2.5, -5.0, -6.5])
#: Labelled pairs of each kind that each half must have for the classifier to be fitted.
LEAST_LABELS = 10


def train(labelled: DataFrame) -> tuple[np.ndarray, float, float, float]:
    """(weights, slope, shift, confidence of a shared number) from all labelled pairs.

    ``labelled`` has FEATURES, ``label`` (null = unknown), ``same_number`` and two names of the profiles, ``a_pid`` and ``b_pid``. The
    classifier is fitted on one half, Platt calibration on the other. Features are flags, so all
    pairs come as counts of their distinct vectors, whatever the number of pairs.
    """
    half = F.pmod(F.xxhash64("a_pid", "b_pid"), F.lit(2)).alias("half")
    rows = labelled.groupBy(*FEATURES, F.coalesce(F.col("label"), F.lit(-1)).cast("int").alias("label"), F.col("same_number").cast("int").alias("same_number"), half).agg(F.count("*").alias("n")).collect()
    t = np.array([[float(v) for v in r] for r in rows]).reshape(len(rows), len(FEATURES) + 4)
    x, y, linked, first, n = t[:, : len(FEATURES)], t[:, -4], t[:, -3] == 1, t[:, -2] == 0, t[:, -1]
    clear = x[:, [FEATURES.index(c) for c in DIFF]].sum(axis=1) == 0
    by_number = float((n[linked & clear].sum() + 1) / (n[linked].sum() + 2)) if linked.any() else 0.5
    use = y >= 0
    if min(n[use & h & (y == v)].sum() for h in (first, ~first) for v in (0, 1)) < LEAST_LABELS:
        return PRIOR, 1.0, 0.0, max(by_number, 0.5)
    f, g = use & first, use & ~first
    w = fit_logistic(x[f], y[f], n[f])
    z = x[g] @ w[:-1] + w[-1]
    slope, shift = fit_logistic(z[:, None], y[g], n[g], ridge=1e-3)
    return w, float(slope), float(shift), by_number


def meeting(one: DataFrame, kind: int, *more: str) -> DataFrame:
    """``a_pid, a, b_pid, b`` of the profiles that meet in a block of that kind, once a block, and columns ``more`` of the listing.

    Blocks are spread by ``k`` and their keys made afterwards, so with ``joined_in_place`` they stay where they are.
    """

    def spread(side: int, name: str, *more: str) -> DataFrame:
        sent = one.filter(F.col("side") == side).select(F.explode(blocks(kind)).alias("k"), "pid", *KNOWN, *more).repartition("k")
        third = {"c": F.col("sk"), "p": F.col("project"), "t": title()}.get(KINDS[kind][1])
        made = sent.select("k", F.col("pid").alias(f"{name}_pid"), F.struct(*KNOWN).alias(name), *more, keys_in(kind, {KINDS[kind][1]: None if third is None else signatures(third)}).alias(f"_{name}"))
        return made.select("*", F.explode(f"_{name}").alias("m"))

    both = spread(0, "a").join(spread(1, "b", *more), ["k", "m"])
    # of the keys that two profiles share in a block the first counts
    return both.filter(F.col("m") == F.get(F.array_intersect("_a", "_b"), F.lit(0))).select("a_pid", "a", "b_pid", "b", *more)


@contextmanager
def joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Within it, tables that are spread by one key of a join are joined without being spread again."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def candidate_pairs(one: DataFrame) -> DataFrame:
    """``a_pid, b_pid``: profiles of the two sides that meet in a block."""
    return reduce(DataFrame.unionByName, (meeting(one, kind).select("a_pid", "b_pid") for kind in range(len(KINDS)))).distinct()


#: Bits of a pair's ``code`` after those of FEATURES: both are known in full, the listing names a number, the posting has it.
WHOLE, NUMBERED, SAME_NUMBER = range(len(FEATURES), len(FEATURES) + 3)


def bit(i: int, of: str = "code") -> Column:
    return F.getbit(F.col(of), F.lit(i)) == 1


def packed(flags: dict[int, Column]) -> Column:
    """Flags as the bits of a number."""
    return reduce(Column.bitwiseOR, (F.when(c, 1 << i).otherwise(0) for i, c in flags.items()))


def coded(met: DataFrame, same_number: bool) -> DataFrame:
    """``a_pid, b_pid, code, own``: what pairs have in common, as bits, and the same by what the listing itself says."""
    of = {i: F.col(c) == 1 for i, c in enumerate(FEATURES)}
    whole = F.lit(True)
    for c in ("sk", "project", "position", "places"):
        whole = whole & F.col(f"a.{c}").isNotNull() & F.col(f"b.{c}").isNotNull()
    code = packed(of | {WHOLE: whole, NUMBERED: F.col("own").isNotNull(), SAME_NUMBER: F.lit(same_number)}).alias("code")
    full = features(met).select("a_pid", "b_pid", "a", "own", code)
    return features(full, "a", "own").select("a_pid", "b_pid", "code", F.when(F.col("own").isNotNull(), packed(of)).alias("own"))


def labels(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """Pairs of listings with a number, as ``train`` takes them: everything is known of them; their features are what they say themselves.

    Profiles go by what they hold, so that the ids of rows don't decide which half a pair falls into.
    """
    each = pairs.filter(bit(NUMBERED)).groupBy("a_pid", "b_pid").agg(F.bit_or("code").alias("code"), F.max("own").alias("own"))
    parted = reduce(Column.__or__, (bit(FEATURES.index(c)) for c in DIFF))
    label = F.when(bit(SAME_NUMBER), 1).when(bit(WHOLE) | parted, F.when(parted, 0).otherwise(1))
    for side in "ab":
        each = each.join(one.select(F.col("pid").alias(f"{side}_pid"), F.lower(F.hex("h")).alias(f"_{side}")), f"{side}_pid")
    return each.select(F.col("_a").alias("a_pid"), F.col("_b").alias("b_pid"), label.alias("label"), bit(SAME_NUMBER).alias("same_number"), *(F.getbit("own", F.lit(i)).cast("double").alias(c) for i, c in enumerate(FEATURES)))


def matches(page: DataFrame, agency: DataFrame, places: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``row_id, listing_id, confidence`` of each pair of rows of one opening."""
    with Scratch(page.sparkSession) as tables, joined_in_place(page.sparkSession):
        rows = tables.keep("rows", described(page, agency, places))
        rows = tables.keep("tagged", tagged(filled(told_levels(rows))))
        tables.drop("rows")
        one = tables.keep("profiles", profiles(rows))
        members = tables.keep("members", rows.select("h", "uid").join(one.select("h", "pid"), "h").select("pid", "uid"))
        tables.drop("tagged")
        for kind in range(len(KINDS)):
            pairs = tables.keep("pairs", coded(meeting(one, kind, "own"), KINDS[kind][0] == "#"))
        w, slope, shift, by_number = train(labels(pairs, one))
        tables.drop("profiles")
        z = sum((F.when(bit(i), float(v)).otherwise(0.0) for i, v in enumerate(w[:-1])), F.lit(float(w[-1])))
        confidence = 1 / (1 + F.exp(-(slope * z + shift)))
        # a pair may have met in several blocks, and its number is known in one of them only
        each = pairs.filter(bit(NUMBERED) | (confidence >= threshold)).groupBy("a_pid", "b_pid").agg(F.bit_or("code").alias("code"))
        scored = each.select("a_pid", "b_pid", F.when(bit(SAME_NUMBER), F.greatest(confidence, F.lit(by_number))).otherwise(confidence).alias("confidence"))
        kept = scored.filter(F.col("confidence") >= threshold)
        left = members.filter("uid % 2 = 0").select(F.col("pid").alias("a_pid"), F.shiftright("uid", 1).alias("row_id"))
        right = members.filter("uid % 2 = 1").select(F.col("pid").alias("b_pid"), F.shiftright("uid", 1).alias("listing_id"))
        return cut(kept.join(left, "a_pid").join(right, "b_pid").select("row_id", "listing_id", F.round("confidence", 6).alias("confidence")))


@query_reading("page_rows", "agency_rows", "places")
def p5_found(page: DataFrame, agency: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs of one opening."""
    return matches(page, agency, places).select("row_id", "listing_id")


@query_reading("page_rows", "agency_rows", "places")
def p5_matches(page: DataFrame, agency: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs of one opening with their confidence."""
    return matches(page, agency, places)


QUERIES = {"p5_found": p5_found, "p5_matches": p5_matches}
