"""Problem 10: personal information inside free text.

Method: offset-preserving deobfuscation. Transducers rewrite the text - look-alike and styled
characters, invisible characters, kinds of space and hyphen, spelled digits, words and brackets
for the signs of an e-mail address - and keep for every output character the source span it came
from. Detectors run over the normalised text; their spans are mapped back, so the source keeps
its spelling and only the items themselves are replaced.

Identity numbers need a label, or a check digit where the label is weak; phone numbers follow number
plans; names need a cue (a title, a closing, a request, an introduction), and after weak cues they
may hold no word of a body or a role. Names without any cue are not found.

Scale: one scan, no shuffle. A JVM expression lets texts without any sign of an item stay out of
Python; the others are handled whole, in Arrow batches, in time linear in their length (patterns
have bounded repeats).

Defined results: null and empty texts have no items and stay as they are; the same item twice in
a document is one row of ``personal_items``, but every occurrence is replaced; overlapping finds
go to the earlier kind of KINDS; a value runs from its first to its last letter or digit;
repeated rows repeat; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import query_reading

#: Kinds in order of precedence and their placeholders.
KINDS = ("email", "id_number", "phone", "address", "name")
#: Cyrillic and Greek letters that look like Latin ones (fixed values).
LOOKALIKE = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTXaeopcyxijsdqwABEZHIKMNOPTYXo", strict=True))
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f"
HYPHENS = "\u2010\u2011\u2012\u2013\u2014\u2212\u05be"
DIGIT_WORDS = {w: str(i) for i, ws in enumerate(("zero oh אפס", "one אחת אחד", "two שתיים שניים", "three שלוש", "four ארבע", "five חמש", "six שש", "seven שבע", "eight שמונה", "nine תשע")) for w in ws.split()}

_ODD = re.compile(f"[^\\x00-\\x7fא-ת]")
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:{_WORDS})(?:[ ,.-]{{1,2}}(?:{_WORDS}|\d)){{4,14}}(?!\w)")
_SPELLED_ONE = re.compile(rf"(?i)(?:{_WORDS})|\d|[ ,.-]+")
#: Words and brackets for the signs of an address.
_AT = r"[ ]{0,2}(?:[\[({<][ ]?(?:at|AT|At|a|ät|arroba|שטרודל|כרוכית|@)[ ]?[\])}>]|@|(?<=[ ])(?:AT|at|שטרודל|כרוכית|arroba)(?=[ ]))[ ]{0,2}"
_DOT = r"(?:[ ]{0,2}[\[({<][ ]?(?:dot|DOT|Dot|punkt|punto|point|נקודה|\.)[ ]?[\])}>][ ]{0,2}|[ ]{1,2}(?:DOT|dot|נקודה|punto)[ ]{1,2}|\.)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_DISGUISED = re.compile(rf"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+%-]{{0,63}}({_AT}){_LABEL}(?:{_DOT}{_LABEL}){{1,5}}(?![\w@])")
_SIGN = re.compile(rf"({_AT})|({_DOT})")


class Trace:
    """A text and, for each of its characters, the source span it stands for (None: itself)."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def rewrite(self, edits: list[tuple[int, int, str]]) -> "Trace":
        """Spans of the text replaced; each new character stands for the whole replaced span."""
        if not edits:
            return self
        n = len(self.text)
        old_starts, old_ends = (self.starts, self.ends) if self.starts is not None else (list(range(n)), list(range(1, n + 1)))
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += old_starts[at:a] + [old_starts[a]] * len(new)
            ends += old_ends[at:a] + [old_ends[b - 1]] * len(new)
            at = b
        return Trace("".join([*text, self.text[at:]]), starts + old_starts[at:], ends + old_ends[at:])

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source span of the characters from ``a`` to ``b``."""
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])


#: What characters become, as far as a worker has met them; there are no more than code points.
_MET: dict[str, str] = {}


def _plain(c: str) -> str:
    r = _MET.get(c)
    if r is None:
        r = _MET[c] = _char(c)
    return r


def _char(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in HYPHENS:
        return "-"
    if c in LOOKALIKE:
        return LOOKALIKE[c]
    if c.isspace():
        return " "
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and n.isascii() and n.isalnum() or n in "@.+()" else "'" if c in "’‘`´׳" else '"' if c in "״“”" else c


def normalise(text: str) -> Trace:
    """The transducers, one after the other."""
    t = Trace(text)
    t = t.rewrite([(m.start(), m.end(), r) for m in _ODD.finditer(text) if (r := _plain(m.group())) != m.group()])
    t = t.rewrite([(m.start(), m.end(), "".join(DIGIT_WORDS.get(x.lower(), x if x.isdigit() else "") for x in _SPELLED_ONE.findall(m.group()))) for m in _SPELLED.finditer(t.text)])
    edits = []
    for m in _DISGUISED.finditer(t.text):
        if m.group(1) != "@" or " " in m.group() or "[" in m.group() or "(" in m.group():
            if m.group(1).strip().isalpha() and not re.search(r"(?i) (?:dot|נקודה|punto) |[\[({<]", m.group()[len(m.group(1)) :]):
                continue  # "look at example.com" is prose
            edits += [(m.start(1), m.end(1), "@")]
            edits += [(m.end(1) + d.start(), m.end(1) + d.end(), ".") for d in re.finditer(_DOT, t.text[m.end(1) : m.end()]) if d.group() != "."]
    return t.rewrite(edits)


_EMAIL = re.compile(rf"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._+%-]{{0,63}}@{_LABEL}(?:\.{_LABEL}){{1,5}}(?![\w@])")
#: Forms of identity numbers: nine digits in groups, social security, national numbers with a check letter.
_ID_FORM = r"(?:\d{9}|\d{3}[ -]\d{3}[ -]\d{3}|\d{8}-\d|\d-\d{7}-\d|\d{3}-\d{2}-\d{4}|\d{8}-?[A-Z](?!\w)|[XYZ]-?\d{7}-?[A-Z](?!\w))"
_IS = r"(?:(?: is| was| ist| est| es)?[ :#=-]{1,3}|)"
_ID = re.compile(
    rf"(?i)(?:\b(?:national id(?:entity)?|id(?:entity)?(?: card)?(?: number| no\.?)|candidate id|teudat zehut|ssn|social security(?: number| no\.?)?|dni|nie)|\bt\.?z\.?|ת\.? ?ז\.?|ת\"ז|תעודת זהות|מספר זהות|מס' זהות){_IS}({_ID_FORM})(?![\d-])"
    rf"|\bfile \(({_ID_FORM})\)(?=[^.\n]{{0,30}}identity)"
    rf"|(?:\b(?:passport|passeport|pasaporte|reisepass)(?: no\.?| number| nr\.?)?|דרכון(?: מספר| מס')?){_IS}([A-Z]{{0,2}}\d{{6,9}})(?!\w)"
)
#: Parts of the labels of identity numbers, lower case.
ID_SIGNS = ("id", "ssn", "social", "dni", "nie", "t.z", "tz", "ת", "zehut", "passp", "pasaporte", "זהות", "דרכון")
_SIX_DIGITS, _DIGIT = re.compile(r"\d(?:[^\w\n]{0,3}\d|[A-Z-]{1,2}\d){5}"), re.compile(r"\d")
#: A bare "ID" may be the number of anything: it opens a clause or has an owner, or the number has a valid check digit.
_BARE_ID = re.compile(r"(?:(?P<own>(?:^|[.;\n(]|\b(?:[Mm]y|[Hh]is|[Hh]er|[Yy]our|[Tt]heir))[ ]?)|(?<![\w#]))ID(?: is|:| no\.?)? (?P<n>\d{9})(?![\w-])")
_PHONE = re.compile(
    r"(?<![\w.+/:-])(?:"
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}"
    r"|(?:972[ -]?\d{1,2}(?:[ -]?\d{3})[ -]?\d{2}[ -]?\d{2})"
    r"|\(0\d{1,2}\)[ .-]?\d{3}[ .-]?\d{4}|0\d{1,2}[ .-]\d{3}[ .-]?\d{4}|05\d{8}"
    r"|\([2-9]\d{2}\)[ .-]?[2-9]\d{2}[ .-]\d{4}|[2-9]\d{2}([.-])[2-9]\d{2}\1\d{4}"  # North American plan
    r"|0[1-9](?:([ .-])\d{2})(?:\2\d{2}){3}"  # French plan
    r")(?![\w/-]|[.:]\d)"
)
_NOT_PHONE = re.compile(r"(?i)(?:order|ref|job no\.?|serial|invoice|version|build|host|ticket|file \(|id|zehut|no\.)[ :#]{0,2}$")
_W = r"[A-ZÀ-Ý][a-zß-ÿ']+"
_FLAT = r"(?:,? (?:apt|apartment|flat|floor|suite|unit)\.? ?\d{1,4})?"
_ADDRESS = re.compile(
    rf"\b\d{{1,4}}[A-Za-z]?,? {_W}(?: {_W})? (?:Street|St\b\.?|st\b\.?|Road|Rd\b\.?|Lane|Ln\b\.?|Ave\b\.?|Avenue|Blvd\b\.?|Boulevard|Drive|Square|Way|Court|Ct\b\.?|Crescent|Terrace|Close|Parkway|Highway|Alley){_FLAT}"
    rf"|\b{_W} (?:Street|St\b\.?|Road|Rd\b\.?|Lane|Ave\b\.?|Avenue|Blvd\b\.?|Boulevard|Drive|Court|Crescent|Terrace) \d{{1,4}}[a-z]?\b{_FLAT}"
    rf"|\b{_W}(?:str\.|stra(?:ss|ß)e|weg|platz|gasse|allee|[ -](?:Str\.|Stra(?:ss|ß)e|Weg|Platz|Allee)) \d{{1,4}}[a-z]?\b(?:,? (?:Whg|Wohnung|Etage|Stock|OG|apt|floor|flat)\.? ?\d{{1,3}})?"
    rf"|\b\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)(?: de la| de l'| des| du| de| d')? ?{_W}(?:,? (?:appt|apt|étage|floor|flat)\.? ?\d{{1,3}})?"
    rf"|\b(?:C/|Calle|Avda\.|Avenida|Paseo|Plaza)(?: de la| del| de)? {_W},? \d{{1,4}}\b(?:,? (?:piso|apt|floor|flat)\.? ?\d{{1,3}})?"
    r"|(?:(?<![א-ת])[בלמה]?(?:רח'|רחוב|שד'|שדרות|סמטת|כיכר|דרך)) [א-ת]+(?:[ -][א-ת]+)? \d{1,4}(?:/\d{1,3})?(?:,? (?:דירה|קומה|כניסה|ד') ?\d{1,3})?"
)
#: Parts of words of an address in any of its languages, lower case; without one there is none (fixed values).
STREET = (
    "str", "st ", "st.", "st,", "road", "rd", "lane", "ln", "ave", "blvd", "boulevard", "drive", "square", "way", "court", "ct", "crescent", "terrace", "close", "parkway", "alley", "weg", "platz", "gasse", "allee",
    "rue", "place", "chemin", "allée", "impasse", "quai", "c/", "calle", "avda", "paseo", "plaza", "רח", "שד", "סמטת", "כיכר", "דרך",
)
_GIVEN = r"(?:[A-Z]\.|[A-Z][a-z]+)(?: [A-Z]\.)?"
_FAMILY = r"(?:O'|D'|Mc|van |ben |bar |de )?[A-Z][a-z]+(?:-(?:O')?[A-Z][a-z]+)?"
_NAME = rf"(?:{_GIVEN} {_FAMILY}|(?:[A-Z]\.|[A-Z]{{2,}})(?: [A-Z]\.)? (?:O'|D')?[A-Z]{{2,}}(?:-(?:O')?[A-Z]{{2,}})?)"
_TITLE = r"(?:Dr|DR|Prof|PROF|Mr|Mrs|Ms|Mx|Herr|Frau|Mme)"
_DR = rf"(?:{_TITLE}\.? )?"
_HE_NAME = r"[א-ת]+'?(?: [א-ת]['.])? [א-ת]+'?(?:-[א-ת]+)?|[א-ת][.'] [א-ת]+(?:-[א-ת]+)?"
_HE_DR = r"(?:(?:ד\"ר|פרופ'|גב'|מר) )?"
_CLOSING = r"(?:[Rr]egards|Thanks|Thank you|Sincerely|Cheers|Yours(?: truly| sincerely)?|Best(?: wishes)?|Grüßen?|Cordialement|Saludos)"
_ASK = r"(?:[Cc]all|[Cc]ontact|[Aa]sk for|[Ee]-?mail|[Ww]rite to|[Ss]peak (?:to|with)|[Tt]alk to|[Mm]eet|[Rr]each out to)"
#: Cues of names: the signs of which one must be there, and the pattern; earlier ones win.
_NAMES = tuple(
    (signs.split("|"), re.compile(pattern))
    for signs, pattern in (
        ("egards|Thanks|incerely|heers|Yours", rf"(?:[Rr]egards|Thanks|Sincerely|Cheers|Yours),\s{{0,4}}{_DR}({_NAME})(?![\w])"),
        ("egards|Thank|incerely|heers|Yours|Best|Grü|ordialement|Saludos", rf"\b{_CLOSING},?[ ]?\r?\n\s{{0,4}}{_DR}({_NAME})(?![\w])"),
        ("interviewer|spoke with|eferred by|Reporting|ecruiter|name", rf"(?:\binterviewer will be |\bI spoke with |\b[Rr]eferred by |\bReporting to |\b[Rr]ecruiter: ?|\b[Mm]y name is |\b(?:[Ff]ull|[Cc]andidate) name: ?){_DR}({_NAME})(?![\w])"),
        ("Contact", rf"\bContact {_DR}({_NAME}) for details"),
        (" wrote", rf"(?<![\w'-]){_DR}({_NAME}) from the \S+ group wrote"),
        ("קשר|בברכה|תודה|שוחחתי|לפנות|דיברתי|שמי|המראיין|הופניתי|בהמלצת", rf"(?:איש קשר: ?|אנשי קשר: ?|בברכה,\s{{0,4}}|תודה,\s{{0,4}}|שוחחתי עם |לפנות אל |דיברתי עם |שמי |המראיין(?:ת)? (?:שלך )?(?:יהיה|תהיה) |הופניתי על ידי |בהמלצת ){_HE_DR}({_HE_NAME})(?![א-ת])"),
        ("lease", rf"\b[Pp]lease {_ASK} {_DR}(?P<weak>{_NAME})(?![\w])"),
        ("Dr|DR|Prof|PROF|Mr|Ms|Mx|Herr|Frau|Mme", rf"\b{_TITLE}\.? (?P<weak>{_NAME}|{_FAMILY})(?![\w])"),
        ("ראיין|חזור אלי|יצור קשר|פגוש|פגש", rf"(?:^|[.!?\n] ?){_HE_DR}(?P<weak>{_HE_NAME}) (?:[ית]ראיין|[ית]חזור אלי|[ית]יצור קשר|[ית]פגוש|[ית]{{1,2}}פגש)"),
    )
)
#: Words that no name of a person holds: bodies, roles and things (fixed values).
_NO_NAME = re.compile(
    r"(?i)\b(?:human|resources|support|sales|customer|service|services|team|department|office|group|labs?|networks?|systems?|center|engineer\w*|developer|manager|recruiting|security|desk|hotline|hiring|talent|company|university|institute|the|our|us|your)\b"
    r"|(?<![א-ת])(?:ה[א-ת]{3,}|מנהלת?|צוות|נציגת?|מגייסת?|מחלקת|ראש|משאבי|אנחנו|אתם|מישהו)(?![א-ת])"
)


def id_checks(n: str) -> bool:
    """The check digit of a nine-digit identity number: every second digit doubled, digits of the sum."""
    return sum(d * w - 9 * (d * w > 9) for d, w in zip(map(int, n), (1, 2) * 5)) % 10 == 0


def items(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the items of ``text`` in source offsets, in order, none overlapping."""
    t = normalise(text)
    s, found = t.text, []
    spans = [(m.start(), m.end(), "email") for m in _EMAIL.finditer(s)] if "@" in s else []
    low = s.lower()
    if _SIX_DIGITS.search(s):
        if any(w in low for w in ID_SIGNS):
            for m in _ID.finditer(s):
                g = next(i for i in (1, 2, 3) if m.group(i))
                spans.append((m.start(g), m.end(g), "id_number"))
            spans += [(m.start("n"), m.end("n"), "id_number") for m in _BARE_ID.finditer(s) if m.group("own") is not None or id_checks(m.group("n"))]
        spans += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(s) if not _NOT_PHONE.search(s[max(0, m.start() - 12) : m.start()])]
    if any(w in low for w in STREET) and _DIGIT.search(s):
        spans += [(m.start(), m.end(), "address") for m in _ADDRESS.finditer(s)]
    for needed, pattern in _NAMES:
        if any(w in s for w in needed):
            for m in pattern.finditer(s):
                if "weak" not in pattern.groupindex or not _NO_NAME.search(m.group(1)):
                    spans.append((m.start(1), m.end(1), "name"))
    rank = {k: i for i, k in enumerate(KINDS)}
    for a, b, kind in sorted(spans, key=lambda x: rank[x[2]]):
        while a < b and not s[a].isalnum():
            a += 1
        while b > a and not s[b - 1].isalnum():
            b -= 1
        if a < b:
            x, y = t.source(a, b)
            if all(y <= p or x >= q for p, q, _ in found):
                found.append((x, y, kind))
    return sorted(found)


def mask(text: str) -> tuple[str, int]:
    """``text`` with typed placeholders, and their number."""
    out, at, n = [], 0, 0
    for a, b, kind in items(text):
        out += [text[at:a], f"[{kind.upper()}]"]
        at, n = b, n + 1
    return "".join([*out, text[at:]]), n


def signs(c: Column) -> Column:
    """Whether a text could hold any item: a JVM expression that lets most clean texts stay out of Python.

    Digits for numbers and addresses, a sign of an e-mail address, a cue of a name; a look-alike or
    invisible character may hide any of them.
    """
    words = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
    low = F.lower(c)
    number = r"\p{Nd}(?:[^\p{L}\p{Nd}\n]{0,4}\p{Nd}|[A-Z-]{1,2}\p{Nd}){5}"
    spelled = rf"(?:{words})(?:[ ,.-]{{1,2}}(?:{words}|\p{{Nd}})){{4}}"
    mail = r"@|＠|[\[({<] ?(?:at|a|ät|arroba|שטרודל|כרוכית) ?[\])}>]| (?:at|arroba|שטרודל|כרוכית) [^\n]{1,80}(?:dot|punto|punkt|point|נקודה|\.)"
    hidden = "[" + "".join(LOOKALIKE) + INVISIBLE + "！-～\U0001d400-\U0001d7ff]"
    street = c.rlike(r"\p{Nd}") & low.rlike("|".join(map(re.escape, STREET)))
    cue = c.rlike("|".join(sorted({w for signs_, _ in _NAMES for w in signs_})))
    return c.rlike(number) | cue | low.rlike(mail) | street | low.rlike(spelled) | c.rlike(hidden)


def personal_items(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, kind, val``: the distinct items of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, vals = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for kind, val in dict.fromkeys((k, t[x:y]) for x, y, k in items(t)) if t else ():
                    ids.append(i), kinds.append(kind), vals.append(val)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.types[0]), pa.array(kinds, pa.string()), pa.array(vals, pa.string())], names=[key, "kind", "val"])

    return docs.select(key, text).filter(signs(F.col(text))).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, kind string, val string")


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, masked, n_items``: each text with placeholders; null stays null.

    Texts without any sign pass by beside Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [mask(t) if t else (t, 0) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], names=[key, "masked", "n_items"])

    some = F.coalesce(signs(F.col(text)), F.lit(False))
    done = docs.select(key, text).filter(some).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, masked string, n_items int")
    return done.unionByName(docs.filter(~some).select(key, F.col(text).alias("masked"), F.lit(0).alias("n_items")))


@query_reading("documents")
def p10_found(documents: DataFrame) -> DataFrame:
    """The distinct items of each document."""
    return personal_items(documents)


@query_reading("documents")
def p10_masked(documents: DataFrame) -> DataFrame:
    """Each text with typed placeholders."""
    return masked(documents)


QUERIES = {"p10_found": p10_found, "p10_masked": p10_masked}
