"""Facts from texts, HTML and embedded JSON, as Column builders (JVM only)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ColumnLike, col, let, quoted, text

UNIT = r"(?:years?|yrs?|שנים|שנות|שנה)"
_N = r"(\d{1,2}(?:\.\d)?)"
#: A number of years, with the character before it, which is no digit and no point.
SINGLE = rf"(^|[^0-9.]){_N} ?\+? ?{UNIT}"
RANGE = rf"(^|[^0-9.]){_N} ?\+? ?(?:-|to |עד ?) ?\d{{1,2}}(?:\.\d)? ?\+? ?{UNIT}"
#: What stands right before a number that is a ceiling or history (at most twelve characters between, no digit).
BLOCK_BEFORE = (
    r"(?:up to|at most|maximum|no more than|less than|fewer than|under|below|within|founded|established|operating for|in business for|since|(?:over|in|for) the (?:last|past)|last|past|history of"
    r"|עד|תוך|פחות מ|לא יותר מ|מנטור עם|קיימת|מזה|לפני)[^0-9]{0,12}\z"
)
#: What stands within 24 characters behind a number that is history or no experience at all.
BLOCK_AFTER = r"^[^\n.;]{0,12}(?:\bago\b|\bsince\b|of (?:growth|history|innovation|operation|success)|in business|warranty|anniversary|\bold\b|track record|אחריות)"
#: Marks of a statement that asks for nothing.
OPTIONAL = r"advantage|a plus\b|nice to have|preferred|preferable|bonus|desirable|optional|יתרון|עדיפות"
#: Headings, alone on a line, of what is optional and of what is asked for.
OPTIONAL_HEADER = "advantages|advantage|nice to have|preferred qualifications|bonus points|bonus|יתרונות|יתרון"
REQUIRED_HEADER = "requirements|minimum qualifications|must have|who you are|what you'll do|what you’ll do|responsibilities|the role|דרישות התפקיד|דרישות|תיאור התפקיד|מה עושים אצלנו"
#: The last heading in a stretch of text.
LAST_HEADER = rf"(?s)^.*(?:^|\n)[^\p{{L}}\n]*({OPTIONAL_HEADER}|{REQUIRED_HEADER})[^\p{{L}}\n]*\n"
#: Characters of context before and behind a number, of its own statement, and of the search for a heading; years that count at most; words a remark behind a dash may have.
AROUND, OWN, HEADER, MAX_YEARS, REMARK = (40, 24), (40, 80), 600, 15, 5
#: Ends of a statement, and a dash that opens the next one.
_STATEMENT, _NEXT = r"[^\n.;•]*", rf" - (?:[^ ]+ +){{{REMARK}}}[^ ].*$"


def _flat(c: Column) -> Column:
    one = F.translate(F.lower(text(c)), "–—\r\t ", "--   ")
    return let(one, lambda x: F.when(x.contains("  "), F.regexp_replace(x, " {2,}", " ")).otherwise(x))


def _asked(t: Column, at: Column, end: Column) -> Column:
    """Whether the number from ``at`` to ``end`` (1-based, exclusive) of the flat text ``t`` is asked for."""
    before = lambda n: F.substring(t, F.greatest(at - n, F.lit(1)), F.least(F.lit(n), at - 1))
    behind = lambda n: F.substring(t, end, F.lit(n))
    own = F.concat_ws(" # ", F.regexp_replace(F.regexp_extract(before(OWN[0]), _STATEMENT + r"\z", 0), "^.* - ", ""), F.regexp_replace(F.regexp_extract(behind(OWN[1]), "^" + _STATEMENT, 0), _NEXT, ""))
    header = F.regexp_extract(before(HEADER), LAST_HEADER, 1)
    return ~before(AROUND[0]).rlike(BLOCK_BEFORE) & ~behind(AROUND[1]).rlike(BLOCK_AFTER) & ~own.rlike(OPTIONAL) & ~header.rlike(f"^(?:{OPTIONAL_HEADER})$")


def parse_years(c: ColumnLike) -> Column:
    """The largest number of years a text requires; null if it requires none.

    Ranges count with their lower bound and leave the text; a single number counts unless it is a
    ceiling, history, or part of an optional statement, or the last heading before it opens optional
    things. Parts of a year count as a whole one; numbers above 15 do not count. Texts that name no
    unit of years cost no pattern search.
    """

    def years(t: Column) -> Column:
        up = lambda x: F.ceil(x.cast("double")).cast("int")
        # a cheap look for a digit before a dash or a word of a range saves most texts the long pattern
        ranges = F.when(t.rlike(r"[0-9] ?\+? ?(?:-|to |עד)"), F.regexp_extract_all(t, F.lit(RANGE), 2)).otherwise(F.array().cast("array<string>"))

        def both(r: Column) -> Column:
            rest = F.when(F.size(r) > 0, F.regexp_replace(t, RANGE, "$1 ~ ")).otherwise(t)
            return F.concat(F.transform(r, up), let(rest, singles))

        def singles(s: Column) -> Column:
            start = F.struct(F.lit(1).alias("at"), F.expr("array()").cast("array<int>").alias("out"))

            def step(a: Column, m: Column) -> Column:
                # every occurrence of the matched words is a match, so the next one is the next match
                at = F.call_function("locate", m, s, a["at"])
                end = at + F.length(m)
                number = at + F.when(m.rlike("^[0-9]"), 0).otherwise(1)
                n = F.regexp_extract(m, r"[0-9]{1,2}(?:\.[0-9])?", 0)
                return F.struct(end.alias("at"), F.when(_asked(s, number, end), F.concat(a["out"], F.array(up(n)))).otherwise(a["out"]).alias("out"))

            return F.aggregate(F.regexp_extract_all(s, F.lit(SINGLE), 0), start, step, lambda a: a["out"])

        return let(ranges, both)

    def found(t: Column) -> Column:
        return F.when(t.rlike("[0-9] ?\\+? ?(?:year|yr|שנ)"), F.array_max(F.filter(let(t, years), lambda n: n <= MAX_YEARS)))

    return let(_flat(col(c)), found)


def years_by(c: ColumnLike, strategy: str) -> Column:
    """struct<lo, hi> by another reading: "min", "first", "minmax", "range_first" or "near" (beside "experien")."""
    s = _flat(col(c))
    if strategy == "near":
        s = F.array_join(F.filter(F.split(s, "\n"), lambda x: x.rlike("experien|ניסיון")), "\n")
    every = F.filter(F.transform(F.regexp_extract_all(s, F.lit(SINGLE), 2), lambda x: F.floor(x.cast("double")).cast("int")), lambda n: n <= 25)
    none = F.lit(None).cast("int")
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    if strategy == "min":
        return pair(F.array_min(every), none)
    if strategy in ("first", "near"):
        return pair(F.get(every, F.lit(0)), none)
    if strategy == "minmax":
        return let(every, lambda e: pair(F.array_min(e), F.when(F.size(e) > 1, F.array_max(e))))
    bounds = rf"(?:^|[^0-9.])(\d{{1,2}})(?:\.\d)? ?\+? ?(?:-|to |עד ?) ?(\d{{1,2}})(?:\.\d)? ?\+? ?{UNIT}"
    lo, hi = (F.nullif(F.regexp_extract(s, bounds, i), F.lit("")).cast("int") for i in (1, 2))
    return F.when(lo.isNotNull(), pair(F.least(lo, hi), F.greatest(lo, hi))).otherwise(pair(F.get(every, F.lit(0)), none))


LEVELS = (
    ("student", r"\b(?:student|intern|trainee|werkstudent)\b|סטודנט"), ("principal", r"\bprincipal\b|ראשי/"), ("lead", r"\b(?:lead|head)\b|מוביל/|ראש צוות"),
    ("senior", r"\b(?:senior|sr)\b|בכיר"), ("staff", r"\bstaff\b"), ("junior", r"\b(?:junior|jr|entry level|graduate)\b|מתחיל"),
)


def level_of(title: ColumnLike, levels: Iterable[tuple[str, str]] = LEVELS) -> Column:
    """Level by an ordered decision list over the title; '' if none."""
    low = F.lower(text(title))
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in levels:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("")


def tags(c: ColumnLike, vocabulary: Iterable[str], cap: int = 12, boundary: str = "both") -> Column:
    """Words of ``vocabulary`` found in the text, in vocabulary order, at most ``cap``.

    ``boundary``: "both" (whole words), "prefix" (word start only) or "none" (substring).
    """
    words, low = list(dict.fromkeys(vocabulary)), F.lower(text(c))
    ends = {"both": (r"(?<![a-z0-9])", r"(?![a-z0-9+#])"), "prefix": (r"(?<![a-z0-9])", ""), "none": ("", "")}[boundary]
    # words of letters, digits and trailing signs are looked up among the words of the text, cut once
    plain = [w for w in words if boundary == "both" and re.fullmatch("[a-z0-9]+[+#]*", w)]
    odd = [F.when(low.rlike(ends[0] + quoted([w]) + ends[1]), F.lit(w)) for w in words if w not in plain]
    have = F.regexp_extract_all(low, F.lit("[a-z0-9]+[+#]*"), 0) if plain else F.expr("array()").cast("array<string>")
    have = F.concat(have, F.filter(F.array(*odd), lambda x: x.isNotNull())) if odd else have
    return F.slice(F.array_intersect(F.array(*map(F.lit, words)), have), 1, cap)


def best_category(c: ColumnLike, categories: Iterable[tuple[str, tuple[str, ...]]], least: int = 2, default: str = "general") -> Column:
    """Category with most words found, at least ``least``; the earliest wins ties."""
    low = F.lower(text(c))
    scored = F.array(*(F.struct(sum((low.contains(w).cast("int") for w in ws), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, ws) in enumerate(categories)))
    return let(F.array_max(scored), lambda m: F.when(m["n"] >= least, m["k"]).otherwise(default))


# HTML

#: Named entities of running text (fixed values); any character may be written by its number.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"), ("&bull;", "•"), ("&middot;", "·"), ("&hellip;", "…"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&pound;", "£"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&deg;", "°"), ("&times;", "×"),
)


def _numbered(s: Column) -> Column:
    """Numeric entities, decimal and hexadecimal, as their characters."""
    p = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"

    def char(e: Column) -> Column:
        hexed = e.rlike("^&#[xX]")
        n = F.when(hexed, F.conv(F.regexp_extract(e, "([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(e, "([0-9]+);", 1)).cast("int")
        # a code point as UTF-32 bytes; what is no character stays as written
        ok = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(e)

    marks, between = F.regexp_extract_all(s, F.lit(p), 0), F.split(s, p, -1)
    joined = F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(char(F.get(marks, i)), F.lit("")))), "")
    return F.when(s.contains("&#"), joined).otherwise(s)


def unescape(c: ColumnLike, times: int = 1) -> Column:
    """Entities of running text resolved, ``times`` times: numbers first, the ampersand last."""
    s = text(c)
    for _ in range(times):
        s = let(s, _numbered)
        for a, b in (*ENTITIES, ("&amp;", "&")):
            s = F.replace(s, F.lit(a), F.lit(b))
    return s


def strip_tags(c: ColumnLike) -> Column:
    """Every tag a blank, entities resolved, single blanks."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(text(c), "<[^>]+>", " ")), r"\s+", " "))


def html_text(c: ColumnLike) -> Column:
    """Running text of a page: scripts and comments out, list items as lines, block ends as line ends."""
    s = F.regexp_replace(text(c), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?i)<li\b[^>]*>", "\n- ")
    s = F.regexp_replace(s, r"(?i)<br\s*/?>|</(?:p|div|ul|ol|h[1-6]|tr|section)\s*>", "\n")
    s = unescape(F.regexp_replace(s, "<[^>]+>", " "))
    lines = F.transform(F.split(F.regexp_replace(s, r"[ \t\r]+", " "), "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: ~x.isin("", "-")), "\n")


def script_json(c: ColumnLike, opening: str, schema: T.DataType | str, twice: bool = False) -> Column:
    """JSON in the first element whose opening tag matches; ``twice`` if it is a JSON string of JSON."""
    body = F.regexp_extract(text(c), rf"(?is){opening}\s*(.*?)\s*</script>", 1)
    if twice:
        body = F.get_json_object(F.concat(F.lit('{"x":'), body, F.lit("}")), "$.x")
    return F.from_json(body, schema)


# truncation to a budget


def word_cut(c: ColumnLike, n: int, slack: int = 200) -> Column:
    """At most ``n`` characters, cut at the last blank if it lies within ``slack`` of the end."""
    head = F.left(text(c), F.lit(n))
    cut_at = F.length(F.regexp_extract(head, r"(?s)^(.*) ", 1))
    return F.when(F.length(text(c)) <= n, text(c)).when((cut_at > 0) & (cut_at >= n - slack), F.left(head, cut_at)).otherwise(head)


def head_and_tail(c: ColumnLike, n: int, marker: str, gap: str = " … ") -> Column:
    """At most ``n`` characters keeping the opening and what follows the first ``marker``."""
    s, at = text(c), F.instr(F.lower(text(c)), marker)
    tail = F.substring(s, at, F.lit(n // 2))
    return F.when(F.length(s) <= n, s).when(at <= n // 2, F.left(s, F.lit(n))).otherwise(F.concat(F.left(s, F.lit(n) - F.length(tail) - len(gap)), F.lit(gap), tail))


def fair_shares(lengths: ColumnLike, budget: int) -> Column:
    """Characters granted to each section: shortest first, each at most an equal part of what is left."""
    order = F.array_sort(F.transform(col(lengths), lambda n, i: F.struct(n.cast("int").alias("n"), i.cast("int").alias("i"))))
    start = F.struct(F.lit(budget).alias("left"), F.lit(0).alias("k"), F.expr("array()").cast("array<struct<i:int,g:int>>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        g = F.least(s["n"], F.floor(a["left"] / (F.size(order) - a["k"])).cast("int"))
        return F.struct((a["left"] - g).alias("left"), (a["k"] + 1).alias("k"), F.concat(a["out"], F.array(F.struct(s["i"].alias("i"), g.alias("g")))).alias("out"))

    return F.transform(F.array_sort(F.aggregate(order, start, step, lambda a: a["out"])), lambda x: x["g"])


def cut_at_markers(c: ColumnLike, markers: Iterable[str]) -> Column:
    """The text up to the earliest of ``markers``."""
    s = text(c)
    low = F.lower(s)
    at = F.array_min(F.filter(F.array(*(F.instr(low, m) for m in markers)), lambda x: x > 0))
    return F.when(at.isNull(), s).otherwise(F.trim(F.left(s, at - 1)))


def two_parts(role: ColumnLike, asked: ColumnLike, budget: int, least: int = 900, gap: str = "\n") -> Column:
    """Two texts in one budget: the first keeps at least ``least`` characters, the second takes the rest, what it leaves goes back."""
    a, b = text(role), text(asked)
    room = F.lit(budget) - F.when((a != "") & (b != ""), len(gap)).otherwise(0)
    first = F.least(F.length(a), F.greatest(F.lit(least), room - F.length(b)))
    second = F.least(F.length(b), F.greatest(room - first, F.lit(0)))
    return F.concat(F.left(a, first), F.when((a != "") & (second > 0), gap).otherwise(""), F.left(b, second))


def first_filled(*cs: ColumnLike) -> Column:
    """The first of the values that is not empty; '' if all are."""
    return F.coalesce(*(F.nullif(F.trim(text(c)), F.lit("")) for c in cs), F.lit(""))


def flat_json(c: ColumnLike) -> Column:
    """All scalar values of any JSON, at whatever depth, in order, joined by blanks; '' for what is no JSON.

    Object keys, brackets and literals without a text (null) leave; strings are unescaped.
    """
    s = text(c)
    # escaped signs stand aside, so that a string is a quote, no quotes, a quote: one loop over a class, of any length
    aside = F.replace(F.replace(s, F.lit("\\\\"), F.lit("\ue000")), F.lit('\\"'), F.lit("\ue001"))
    back = lambda t: F.replace(F.replace(t, F.lit("\ue001"), F.lit('\\"')), F.lit("\ue000"), F.lit("\\\\"))
    token = r'"[^"]*"\s*:?|-?[0-9][0-9.eE+-]*|true|false'
    values = F.filter(F.regexp_extract_all(aside, F.lit(token), 0), lambda t: ~F.rtrim(t).endswith(":"))
    plain = F.transform(values, lambda t: F.when(t.startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), back(t), F.lit("}")), "$.x")).otherwise(t))
    return F.when(F.try_parse_json(s).isNotNull(), F.array_join(F.filter(plain, lambda t: F.trim(t) != ""), " ")).otherwise("")


def without_spans(c: ColumnLike, spans: Iterable[tuple[str, str]], most: int = 300, every: bool = True) -> Column:
    """The text without boilerplate from each opening to the nearest closing at most ``most`` characters on; ``every`` or the first."""
    s = text(c)
    for a, b in spans:
        p = rf"(?is){quoted([a])}.{{0,{most}}}?{quoted([b])}"
        s = F.regexp_replace(s, p, " ") if every else F.regexp_replace(s, rf"(?is)^(.*?){p}(.*)$", "$1 $2")
    return F.trim(F.regexp_replace(s, "[ \t]{2,}", " "))


def canonical_city(c: ColumnLike, aliases: Iterable[tuple[str, str]], countries: Iterable[str], drop: Iterable[str] = (), most: int = 3) -> Column:
    """Cities of a location, in order: split, country names off, aliases replaced, dropped ones out, at most ``most``, joined by slashes.

    If only dropped cities are named, those stay.
    """
    aliases, countries, drop = dict(aliases), tuple(countries), tuple(drop)
    fold = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    parts = F.filter(F.transform(F.split(text(c), r"[;,/|]"), lambda x: F.trim(F.regexp_replace(x, r"\([^)]*\)", ""))), lambda x: (x != "") & ~fold(x).isin(*countries))
    named = F.transform(parts, lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(y) for p in aliases.items() for y in p]), fold(x)), x) if aliases else x)
    every = F.array_distinct(named)
    near = F.filter(every, lambda x: ~fold(x).isin(*drop)) if drop else every
    return let(F.when(F.size(near) > 0, near).otherwise(every), lambda xs: F.array_join(F.slice(xs, 1, most), " / "))


def labelled(c: ColumnLike, labels: Iterable[str]) -> Column:
    """``label: value | label: value`` of the labels present, values up to a bar or line end."""
    s = text(c)
    parts = [F.nullif(F.trim(F.regexp_extract(s, rf"(?i){quoted([x])}:\s*([^|\n]+)", 1)), F.lit("")) for x in labels]
    return F.concat_ws(" | ", *(F.when(p.isNotNull(), F.concat(F.lit(f"{x}: "), p)) for x, p in zip(labels, parts, strict=True)))


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def day_number(c: ColumnLike) -> Column:
    """``26 Aug 2026`` (months by their first letters) as 20260826; 0 if it is no date."""
    p = r"(?i)^\s*(\d{1,2})\s+([a-z]{3})[a-z]*\.?\s+(\d{4})"
    d, m, y = (F.regexp_extract(text(c), p, i) for i in (1, 2, 3))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(m)).cast("int")
    return F.when((y != "") & (month > 0), F.nullif(y, F.lit("")).cast("int") * 10000 + month * 100 + F.nullif(d, F.lit("")).cast("int")).otherwise(0)


WORD_NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def spelled_numbers(c: ColumnLike) -> Column:
    """``three years`` -> ``3 years``."""
    s = text(c)
    for i, w in enumerate(WORD_NUMBERS, 1):
        s = F.regexp_replace(s, rf"(?i)\b{w}(?=[ -]+(?:\(\d+\) )?years?\b)", str(i))
    return s


def strip_request_prefix(c: ColumnLike) -> Column:
    """``12345 - Title`` -> ``Title``."""
    return F.regexp_replace(text(c), r"^\d{3,}\s*[-–]\s*", "")


def slug(c: ColumnLike) -> Column:
    """Letters and digits of a title joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def id_from_path(c: ColumnLike) -> Column:
    """The last run of four or more digits of a link; '' if none."""
    return F.regexp_extract(text(c), r"(\d{4,})(?!.*\d{4,})", 1)


def percent_decoded(c: ColumnLike) -> Column:
    """Percent-escapes resolved where there are any; plus signs stay."""
    s = text(c)
    return F.when(s.contains("%"), F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)).otherwise(s)


def tidy_location(c: ColumnLike) -> Column:
    """'' for pay ranges; the Latin name of a raw geo record; else single blanks."""
    s = F.trim(F.regexp_replace(text(c), r"\s+", " "))
    return F.when(s.rlike(r"[₪$€]|\d{2},\d{3}"), "").when(text(c).rlike(r"\t"), F.trim(F.regexp_extract(text(c), r"\t\s*([A-Za-z][A-Za-z' -]+)", 1))).otherwise(s)
