"""Text problems: encodings, cuts, site lines, tokens, personal information."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.llm import p01_encoding as p1
from sievework.llm import p03_cut as p3
from sievework.llm import p04_site_lines as p4
from sievework.llm import p08_tokens as p8
from sievework.llm import p10_personal as p10

HEBREW = "מהנדס/ת תוכנה – ראש צוות"


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "cp1255", "cp1250", "cp437", "mac_roman"])
@pytest.mark.parametrize("text", ["Ingénieur qualité – Ziel", HEBREW, "“quoted” • item…"])
def test_restores_misread_utf8(page, text):
    try:
        bad = text.encode().decode(page)
    except UnicodeDecodeError:
        bad = "".join(bytes([b]).decode(page, "replace").replace("�", chr(b)) for b in text.encode())
    got, pages, lost = p1.repair("ok " + bad + " end")
    assert pages and got == "ok " + text + " end" and not lost


def test_restores_twice_misread_and_spans_only():
    bad = "é".encode().decode("cp1252").encode().decode("cp1252")
    assert p1.repair(f"Caf{bad} and São Ângulo 10× faster")[0] == "Café and São Ângulo 10× faster"
    assert p1.repair("שלום".encode("cp1255").decode("cp1252") + " abc")[0] == "שלום abc"


@pytest.mark.parametrize("text", ["déjà vu – naïve", "Größe – naïve", "Müller & Söhne", HEBREW, "Świętosława – Żółć"])
@pytest.mark.parametrize("page", ["cp1252", "cp1250", "latin-1", "cp437"])
def test_restores_any_number_of_layers(text, page):
    bad = text
    for _ in range(5):
        bad = "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in bad.encode())
        assert p1.repair(bad)[0] == text and not p1.repair(bad)[2]


def test_restores_layers_of_different_pages():
    bad = "déjà vu Größe".encode().decode("cp1252").encode().decode("cp437")
    assert p1.repair(bad)[:2] == ("déjà vu Größe", ["cp437", "cp1252"])


@pytest.mark.parametrize("clean", ["", "OPERAÇÃO E INTEGRAÇÃO", "à la carte 90k–95k €", "Ready for X??? Good", HEBREW, "10× faster, “hello” — twice", "Übung für Großkunden"])
def test_clean_text_stays(clean):
    assert p1.repair(clean) == (clean, [], False)


def test_lost_characters_are_reported():
    assert p1.repair("a � b")[2] and p1.repair("???? ?? ????? x")[2]


def test_automaton_spans():
    assert p1.multibyte_spans("é–x".encode()) == [(0, 5, False)]
    assert p1.multibyte_spans(b"\xe2\x80 ") == [(0, 2, True)]
    assert p1.multibyte_spans(b"\xc3\x28\xff") == []


def test_garbled_edges(spark):
    schema = "ord long, title string, desc string, stored string"
    bad = "é".encode().decode("cp1252")
    df = spark.createDataFrame([(1, None, None, "x"), (2, "", bad, "x"), (3, bad, bad * 20000, "x"), (3, bad, bad * 20000, "x")], schema)
    assert sorted((r.ord, r.field) for r in p1.garbled(df).collect()) == [(2, "desc"), (3, "desc"), (3, "desc"), (3, "title"), (3, "title")]
    assert p1.garbled(df.limit(0)).count() == 0


def _posts(spark, rows):
    return spark.createDataFrame(rows, "ord long, source string, desc string, line string")


def test_site_lines_edges(spark):
    site, own = "  Apply through  our SITE today, please! ", "a line of one posting only, number %d"
    rows = [(i, "s", f"{own % i}\r\n{site}\n{site.lower()}", "x") for i in range(8)] + [(100, "s", None, "x"), (101, "s", "", "x"), (102, None, site, "x"), (103, "t", site, "x")]
    got = sorted((r.ord, r.line_no) for r in p4.marked_lines(_posts(spark, rows)).collect())
    assert got == sorted((i, n) for i in range(8) for n in (2, 3))  # one text repeating a line counts once, other sources stay apart
    clean = {r.ord: r.clean_desc for r in p4.remove_site_lines(_posts(spark, rows)).collect()}
    assert clean[0] == own % 0 + "\r" and clean[100] is None and clean[101] == "" and clean[103] == site
    assert p4.marked_lines(_posts(spark, rows).limit(0)).count() == 0


def test_cut_texts_edges(spark):
    rnd = random.Random(5)
    words = ["rust", "kafka", "linux", "docker", "python"]
    full = lambda: "\n".join(f"- Experience with {rnd.choice(words)} and {rnd.choice(words)} in teams of {rnd.randrange(9)}." for _ in range(rnd.randrange(3, 16)))
    rows = [(i, "cutting", full()[:300], "x") for i in range(200)] + [(i, "whole", full(), "x") for i in range(1000, 1300)]
    rows += [(2000, "whole", "Some text that goes on and... (more)", "x"), (2001, "whole", None, "x"), (2002, "whole", "  ", "x"), (2003, "whole", full() + "\n- Experience with ru", "x"), (2004, None, "We offer tea, and much more...", "x")]
    found = {r.ord for r in p3.cut_texts(_posts(spark, rows)).collect()}
    truly = {i for i, s, d, _ in rows if s == "cutting" and len(d) == 300}
    assert truly - found == set() and {2000, 2003} <= found and not {2001, 2002, 2004} & found
    assert len({o for o in found if 1000 <= o < 1300}) == 0
    assert p3.cut_texts(_posts(spark, rows).limit(0)).count() == 0


def test_cuts_that_share_their_last_words_are_found(spark):
    rnd = random.Random(7)
    body = lambda n: "\n".join(f"Years of experience with {rnd.choice('abcdef') * rnd.randrange(2, 30)} and tools" for _ in range(n))
    ends = ["Years of expe", "Years of experience with", "Years of", "Ye"]
    for times in (1, 12):  # the more rows, the more texts are cut at the same words
        rows = [(i, "s", f"{body(3 + i % 9)}\n{ends[i % 4]}", "x") for i in range(4 * times)]
        rows += [(1000 + i, "s", f"{body(3 + i % 9)}\nApply right here", "x") for i in range(40 * times)]  # closes texts only, and never goes on
        rows += [(5000 + i, "s", f"{body(3 + i % 9)} ", "x") for i in range(40 * times)]
        assert {r.ord for r in p3.cut_texts(_posts(spark, rows)).collect()} == set(range(4 * times))


@pytest.fixture(scope="module")
def ranks():
    return p8.load_ranks(f"{p8.TOKENIZERS}/byte_bpe_50k.tiktoken")


def brute_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if r == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_merge_equals_brute_force(ranks):
    rnd = random.Random(11)
    for _ in range(400):
        piece = bytes(rnd.choice(b"abcdefghi nrst \xd7\x90\xe2\x80") for _ in range(rnd.randrange(1, 60)))
        assert p8.merge_piece(piece, ranks) == brute_merge(piece, ranks)


def test_encode_against_library(ranks, spark):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=p8.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "Hello  world\n\n", HEBREW, "<|endoftext|>", "a" * 5000, " \t  x", "👩‍💻🚀", "don't WE'LL 123abc"]
    encode = p8.encoder(ranks)
    assert [encode(t) for t in texts] == [lib.encode_ordinary(t) for t in texts] and encode(None) == []
    df = spark.createDataFrame([(1, None, [1]), (2, "", [1]), (3, "tea", [1]), (3, "tea", [1])], "doc_id long, text string, ids array<int>")
    assert sorted((r.doc_id, list(r.ids)) for r in p8.encode_texts(df).collect()) == [(1, []), (2, []), (3, lib.encode_ordinary("tea")), (3, lib.encode_ordinary("tea"))]
    assert p8.encode_texts(df.limit(0)).count() == 0


CASES = [
    ("Send to jobs AT acme DOT example now", [("email", "jobs AT acme DOT example")]), ("Write to <a.b+c@x.co.example> before", [("email", "a.b+c@x.co.example")]), ("mail hr.team [at] acme.example;", [("email", "hr.team [at] acme.example")]),
    ("Tel: +972 (0)52 555 3026", [("phone", "972 (0)52 555 3026")]), ("Call (03) 555-2612 after 10:00.", [("phone", "03) 555-2612")]), ("dial zero five two five five five one two three four", [("phone", "zero five two five five five one two three four")]),
    ("ID number 888 535 952 was used", [("id_number", "888 535 952")]), ("Order 675423895 shipped", []), ("Lab host 10.0.2.17 runs build 2026.02.11", []), ("Serial 0525-5531 belongs", []), ("passport X3262184, valid until 2031", [("id_number", "X3262184")]),
    ("Visit us: 61 Novanra St., apt 5", [("address", "61 Novanra St., apt 5")]), ("Visit us: 145 bis rue Garellit", [("address", "145 bis rue Garellit")]), ("Interviews at Basuvdastr. 161, Town", [("address", "Basuvdastr. 161")]), ("C/ Garazniv, 100", [("address", "C/ Garazniv, 100")]),
    ("Best regards,\nDr. Koori O'Varnosky-Telov", [("name", "Koori O'Varnosky-Telov")]), ("Reporting to Yarish D. Drazosky in Marevshet", [("name", "Yarish D. Drazosky")]), ("איש קשר: ד\"ר רביד ורניק", [("name", "רביד ורניק")]), ("Contact Support for details", []), ("Budget of 1,450,000 ₪", []), ("", []),
    ("mаil jоbs@acme.example", [("email", "jоbs@acme.example")]),
    ("Please call Dana Levi tomorrow", [("name", "Dana Levi")]), ("Best,\nJohn Smith", [("name", "John Smith")]), ("Kind regards\nDana Levi", [("name", "Dana Levi")]), ("My name is Maria Gonzalez", [("name", "Maria Gonzalez")]), ("Dr. Ruth Klein spoke", [("name", "Ruth Klein")]),
    ("רביד ורניק יראיין אותך מחר", [("name", "רביד ורניק")]), ("מנהל הצוות יראיין אותך", []), ("Please contact Human Resources", []), ("call (212) 555-0147 now", [("phone", "212) 555-0147")]), ("SSN 123-45-6789", [("id_number", "123-45-6789")]), ("ID 123456789", [("id_number", "123456789")]),
    ("job ID 123456789", []), ("user ID 123456782", [("id_number", "123456782")]), ("passport is 12345678", [("id_number", "12345678")]), ("14 Elm Court", [("address", "14 Elm Court")]), ("tél. 01 42 68 53 00", [("phone", "01 42 68 53 00")]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_personal_items(text, want):
    assert [(k, text[a:b]) for a, b, k in p10.items(text)] == want


def test_mask_keeps_the_rest(spark):
    assert p10.mask("x a@b.example y a@b.example.") == ("x [EMAIL] y [EMAIL].", 2)
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "a@b.example " * 5000, "k"), (3, "a@b.example", "k")], "doc_id long, text string, kind string")
    assert sorted((r.doc_id, r.val) for r in p10.personal_items(df).collect()) == [(3, "a@b.example"), (3, "a@b.example")]
    assert {r.doc_id: (r.masked, r.n_items) for r in p10.masked(df.filter("doc_id < 3")).collect()} == {1: (None, 0), 2: ("", 0)}
    assert p10.personal_items(df.limit(0)).count() == 0


def test_signs_pass_every_text_with_items(spark):
    texts = [t for t, _ in CASES] + ["no items in this text at all", "we meet at the office"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in df.filter(p10.signs(F.col("text"))).collect()}
    assert {i for i, t in enumerate(texts) if p10.items(t)} <= kept and not {len(texts) - 2, len(texts) - 1} & kept


def test_offsets_of_transducers():
    t = p10.normalise("a​b‑c zero one two three four five!")
    assert t.text == "ab-c 012345!" and t.source(5, 6) == (6, 34) and p10.normalise("plain").source(1, 3) == (1, 3)
