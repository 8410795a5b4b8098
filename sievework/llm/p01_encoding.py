"""Problem 1: text that was decoded with the wrong character encoding.

Method: map characters back to the bytes of a legacy code page, run a byte-structure automaton
(the UTF-8 state machine) over those bytes to find maximal well-formed multibyte spans, and
decode those spans only - again and again, as text may have been garbled more than once: a search
over sequences of pages, of any depth, decides which pages explain a text whole. Bytes
of a Hebrew code page read as a Latin one are found by their letters (words of nothing but
letters from U+00E0 to U+00FA) and mapped back by the same tables. What a replacement character
or a question mark took is reported and left as it is.

Scale: one scan; a JVM regular expression on character pairs passes only suspicious fields
(some percent) to Arrow-batched Python. No shuffle.

Defined results: null and empty fields are clean; restored text equals the stored text where
nothing can be restored; very long texts are handled whole in linear time; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import query_reading

#: Code pages that readers fall back to, most usual first (fixed values).
CODE_PAGES = ("cp1252", "cp1255", "cp1250", "cp437", "mac_roman", "cp850", "cp862", "cp1251", "cp866")
#: Scripts a restored character may belong to: Latin, Greek, Cyrillic, Hebrew, punctuation, currency, symbols.
PLAUSIBLE = re.compile("[\u00a0-\u017f\u02c6-\u02dd\u0370-\u04ff\u0590-\u05f4\u1e00-\u1eff\u2000-\u2069\u20a0-\u20bf\u2100-\u27bf\ufb1d-\ufb4f\ufeff\U0001f000-\U0001faff]")


def _to_bytes(page: str) -> dict[str, int]:
    """Character -> byte of the page's upper half; bytes it leaves undefined stand for themselves."""
    table = {chr(b): b for b in range(0x80, 0xA0)} if page.startswith("cp12") else {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


TO_BYTES = {page: _to_bytes(page) for page in CODE_PAGES}
_RUNS = {page: re.compile("[" + "".join(map(re.escape, table)) + "]{2,}") for page, table in TO_BYTES.items()}
_LEAD = {page: {c for c, b in t.items() if 0xC2 <= b <= 0xF4} for page, t in TO_BYTES.items()}
_CONT = {page: {c for c, b in t.items() if 0x80 <= b <= 0xBF} for page, t in TO_BYTES.items()}
_PAIR = {page: re.compile("[" + "".join(map(re.escape, _LEAD[page])) + "][" + "".join(map(re.escape, _CONT[page])) + "]") for page in CODE_PAGES}


def multibyte_spans(data: bytes) -> list[tuple[int, int, bool]]:
    """Maximal spans of well-formed multibyte sequences in ``data``: (start, end, cut short).

    The automaton has the states of UTF-8: a lead byte sets the number and the first range of
    continuation bytes; any other byte ends the span. A three- or four-byte sequence that breaks
    off after its second byte closes its span as cut short.
    """
    spans: list[tuple[int, int, bool]] = []
    i, n = 0, len(data)
    while i < n:
        b = data[i]
        need = 1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else 0
        lo, hi = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
        j = i + 1
        while need and j < n and j - i <= need and lo <= data[j] <= hi:
            lo, hi, j = 0x80, 0xBF, j + 1
        if need and j - i == need + 1:
            start = spans.pop()[0] if spans and spans[-1][1] == i and not spans[-1][2] else i
            spans.append((start, j, False))
            i = j
        else:
            if need >= 2 and j - i == need:
                spans.append((i, j, True))
            i = max(j, i + 1) if need and j > i + 1 else i + 1
    return spans


def _plausible(out: str, text: str, a: int, b: int, table: dict[str, int]) -> bool:
    # a layer below another one consists of the page's own characters
    if not all(PLAUSIBLE.match(c) or c in table for c in out if c > "\x7f"):
        return False
    if len(out) == 1 and "\u05d0" <= out <= "\u05ea":  # a lone letter behind a number is a sign of multiplication with a quote
        return not (a and text[a - 1].isdigit())
    return True


def _unfold(text: str, page: str) -> tuple[str, int, int]:
    """One layer off: (text, restored spans, spans cut short)."""
    table, out, at, done, cut = TO_BYTES[page], [], 0, 0, 0
    for m in _RUNS[page].finditer(text):
        data = bytes(table[c] for c in m.group())
        for a, b, short in multibyte_spans(data):
            if short:
                # two bytes of three, in the page of general punctuation, are never written on purpose
                cut += data[a] == 0xE2 and data[a + 1] == 0x80
                continue
            s = data[a:b].decode("utf-8")
            if _plausible(s, text, m.start() + a, m.start() + b, table):
                out += [text[at : m.start() + a], s]
                at, done = m.start() + b, done + 1
    return "".join([*out, text[at:]]), done, cut


_LATIN_RUN = re.compile("[\u00e0-\u00fa\u00f7]{3,}")
_LATIN_ANY = re.compile("(?<![A-Za-z\u00c0-\u00ff])[\u00e0-\u00fa\u00f7]+")
_MARKS = re.compile("(?<![^\\W_])\\?{2,}")
#: Letters that restored text hardly ever holds.
_RARE = re.compile("[\u0080-\u009f\u0192\u0100-\u0151\u0154-\u015f\u0162-\u0177\u0179-\u017c\u0370-\u04ff]")
_LOST = re.compile("\ufffd")


def peel(text: str) -> tuple[str, list[str], bool]:
    """(text without its layers, code page of each layer, outermost first, anything cut short).

    A search over sequences of pages, depth first: the page of the layer before is tried first, as
    text passes the same faulty reader again and again, then the usual ones. A state has no layer
    left when no page explains any span of it. The first such state with no span cut short and no
    rare letters ends the search; where there is none, the one that explains most wins, rare
    letters, cuts and changes of page counting against it. Every layer makes the
    text shorter, so the search ends, however deep the layers are; re-encoding the restored spans
    by the pages in reverse gives the stored text again, as the tables are one to one.
    """
    best, seen = None, {text}
    stack: list[tuple[str, tuple[str, ...], int]] = [(text, (), 0)]
    while stack:
        state, layers, cut = stack.pop()
        order = CODE_PAGES if not layers else (layers[-1], *(p for p in CODE_PAGES if p != layers[-1]))
        on, short = [], None
        for page in order:
            if not _PAIR[page].search(state):
                continue
            new, done, broken = _unfold(state, page)
            if done:
                on.append((new, (*layers, page), broken))
            elif broken and short is None:
                short = page
        if on:
            stack += [x for x in reversed(on) if x[0] not in seen]
            seen.update(x[0] for x in on)
            continue
        rare, changes = len(_RARE.findall(state)), sum(a != b for a, b in zip(layers, layers[1:]))
        left = (cut if layers else 0) or int(short is not None)
        score = len(text) - len(state) - 4 * rare - 2 * left - changes
        found = (score, state, [*layers, *([short] if short else [])], bool(left))
        if not left and not rare:
            return found[1:]
        if best is None or score > best[0]:
            best = found
    return best[1:] if best else (text, [], False)


def repair(text: str) -> tuple[str, list[str], bool]:
    """(restored text, code pages found, anything left that cannot be restored)."""
    pages: list[str] = []
    lost = bool(_LOST.search(text))
    if _LATIN_RUN.search(text):
        # runs of such letters never come from multibyte text, whose continuation bytes lie lower
        back = {c: bytes([b]).decode("cp1255", "ignore") or c for c, b in TO_BYTES["cp1252"].items() if b >= 0xE0}
        text = _LATIN_ANY.sub(lambda m: "".join(back.get(c, c) for c in m.group()), text)
        pages.append("hebrew-as-latin")
    text, layers, cut = peel(text)
    lost |= cut
    pages += layers
    gone = _MARKS.findall(text)
    if len(gone) >= 2 or any(len(g) > 3 for g in gone):
        pages.append("question-marks")
        lost = True
    return text, pages, lost


def _class(chars: set[str]) -> str:
    """A Java character class of ``chars`` (code points above ASCII), as ranges."""
    points, out = sorted(ord(c) for c in chars), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(f"\\u{a:04x}" + (f"-\\u{b:04x}" if b > a else "") for a, b in out) + "]"


def suspicious(c: Column) -> Column:
    """Whether the automaton could find a span in ``c``: a lead character before a continuation."""
    lead, cont = _class(set().union(*_LEAD.values())), _class(set().union(*_CONT.values()))
    # almost all texts fall at the first, cheap expression: no two neighbours beyond ASCII that are not Hebrew
    guard = c.rlike(r"[^\x00-\x7f\u05d0-\u05ea][^\x00-\x7f]|\ufffd|\?\?")
    return guard & c.rlike("|".join([lead + cont, r"\ufffd", r"[\u0080-\u009f]", r"[\u00e0-\u00fa]{3}", r"(?<![\p{L}\p{N}?])\?\?"]))


FOUND = pa.schema([("ord", pa.int64()), ("field", pa.string()), ("stored", pa.string()), ("restored", pa.string()), ("pages", pa.list_(pa.string())), ("whole", pa.bool_())])


def _repair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for o, f, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            restored, pages, lost = repair(t)
            if pages or lost:
                rows.append({"ord": o, "field": f, "stored": t, "restored": restored, "pages": pages, "whole": not lost})
        yield pa.RecordBatch.from_pylist(rows, schema=FOUND)


def garbled(rows: DataFrame, key: str = "ord", fields: tuple[str, ...] = ("title", "desc")) -> DataFrame:
    """``ord, field, stored, restored, pages, whole`` of each garbled field of ``rows``."""
    each = rows.select(F.col(key).alias("ord"), *fields)
    some = suspicious(F.col(fields[0]))
    for f in fields[1:]:
        some = some | suspicious(F.col(f))
    long = each.filter(some).select("ord", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("x"))
    todo = long.select("ord", "x.field", "x.text").filter("text is not null and text <> ''").filter(suspicious(F.col("text")))
    return todo.mapInArrow(_repair_batches, "ord bigint, field string, stored string, restored string, pages array<string>, whole boolean")


@query_reading("postings")
def p1_found(postings: DataFrame) -> DataFrame:
    """Each garbled field."""
    return garbled(postings).select("ord", "field")


@query_reading("postings")
def p1_restored(postings: DataFrame) -> DataFrame:
    """Each garbled field with its restored text."""
    return garbled(postings).select("ord", "field", "restored", F.array_join("pages", ",").alias("pages"), "whole")


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored}
