"""Set forms against the loops they stand for, and vectors of the scalar rules."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import extract as X
from sievework.functions import region as G
from sievework.functions import text as T
from sievework.operators import buckets as B
from sievework.operators import classify as C
from sievework.operators import collapse as CO
from sievework.operators import overlay as O
from sievework.operators import publish as P
from sievework.operators import relational as R
from sievework.operators import state as ST


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


REGIONS = [("Dovitma", "North"), ("Kelitda / Dovitma", "North"), ("Kelitda, Marakma", "South"), ("Marakma", "Jerusalem"), ("Velograd", "Abroad"), ("Velograd, Israel", "Unknown"), ("Remote", "Unknown"), ("5 Locations", "Unknown"),
           ("Elsewhere", "Center"), ("", "Unknown"), (None, "Unknown"), ("Neve-Zolan (Hybrid)", "North"), ("בדוביטמה", "North"), ("Dovitmaville", "Center"), ("Velograd; Marakma", "Jerusalem"), ("Velograd and Kelitda", "South"), ("Elsewhere, Velograd", "Center")]


def test_region(spark):
    names = [(1, "Dovitma", "דוביטמה", "North"), (2, "Neve Zolan", None, "North"), (3, "Kelitda", None, "South"), (4, "Marakma", None, "Jerusalem"), (5, "Velograd", None, "Abroad")]
    places = spark.createDataFrame(names, "place_id long, name_en string, name_he string, region string")
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REGIONS)], "i long, loc string")
    got = {r.i: r.region for r in G.with_region(df, "loc", places).collect()}
    assert got == {i: w for i, (_, w) in enumerate(REGIONS)}
    assert G.with_region(df.limit(0), "loc", places).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [("5+ years of experience", 5), ("3-5 years in the field", 3), ("Up to 9 years of practice", None), ("Advantages:\n7 years of Go\nRequirements:\n2 years of C", 2), ("10 years of rust, an advantage", None), ("ניסיון של 4 שנים לפחות", 4), ("עד 9 שנות ניסיון", None),
     ("founded 40 years ago", None), ("founded 12 years ago, we need 3 years", 3), ("operating for 12 years. 1-2 years of practice", 1), ("2 years warranty", None), ("5+ years preferred", None), ("3.5 years of C", 4), ("100 years of history", None), ("12 years of growth. 2 years of rust", 2),
     ("docker - advantage - 3+ years of go", 3), ("3+ years of hands-on work on backend services in go - familiarity with clouds, an advantage", 3), ("3 years - a plus", None), ("6+ years of java (go is nice)", 6), ("5+ years in the industry", 5),
     ("ניסיון של 2 שנות פיתוח - דרושה היכרות עם כלי ענן ועוד כמה - עבודה עם לינוקס - יתרון", 2), ("1-2 years", 1), ("16 years of go", None), ("5 years of a, 7.5 years of b", 8), ("Requirements:\n2+ years of go\nAdvantages:\n5+ years of rust", 2), ("", None), (None, None), ("2 years of a\n6 years of b", 6)],
)
def test_years(spark, text, want):
    assert one(spark, text, X.parse_years) == want


@pytest.mark.parametrize(("text", "want"), [("26 Aug 2026", 20260826), ("3 September 2025", 20250903), ("soon", 0), (None, 0)])
def test_day_number(spark, text, want):
    assert one(spark, text, X.day_number) == want


def test_small_parsers(spark):
    assert one(spark, "12345 - Title", X.strip_request_prefix) == "Title"
    assert one(spark, "three years and two dogs", X.spelled_numbers) == "3 years and two dogs"
    assert one(spark, "a%20b+c", X.percent_decoded) == "a b+c"
    assert one(spark, "https://a.b/x/123456/y", X.id_from_path) == "123456"
    assert one(spark, "<p>a &amp;amp; b</p>", lambda c: X.unescape(X.strip_tags(c))) == "a & b"
    assert one(spark, "<ul><li>one</li><li>two</li></ul><script>var x='</p>'</script>", X.html_text) == "- one\n- two"
    assert one(spark, "Area: R&D | Type: full\nmore", lambda c: X.labelled(c, ("Type", "Area"))) == "Type: full | Area: R&D"


@pytest.mark.parametrize(("c", "names", "want"), [("Merrabria Payments", ("merrabria",), True), ("merrabriapayments", ("merrabria",), True), ("Merrabriana", ("merrabria",), False), ("", ("merrabria",), False), (None, ("x",), False)])
def test_company_is(spark, c, names, want):
    assert one(spark, c, lambda x: T.company_is(x, names)) is want


def test_fair_shares(spark):
    def loop(lengths, budget):
        out, left, order = [0] * len(lengths), budget, sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
        for k, i in enumerate(order):
            out[i] = min(lengths[i], left // (len(lengths) - k))
            left -= out[i]
        return out

    cases = [[10, 500, 30], [], [100] * 7, [5, 5, 900, 2]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, l array<int>")
    assert [r.s for r in df.orderBy("i").select(X.fair_shares("l", 200).alias("s")).collect()] == [loop(c, 200) for c in cases]


def _jobs(spark, rows):
    return spark.createDataFrame(rows, "ord long, source string, sid string, company string, title string, region string, city string, url string")


def test_dedup_equals_loop(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice("abc"), str(rnd.randrange(4)), rnd.choice(["Acme", "", None, "Bolt"]), rnd.choice(["Dev One", "dev  one", "Ops"]), rnd.choice(["North", "Center"]), "", f"u{i}") for i in range(300)]
    by, out = {}, []
    for o, s, sid, co, t, r, *_ in rows:
        k = (co.lower(), " ".join(t.lower().split()), r) if co else ("", s, sid)
        if any((s, sid) in kept["m"] for kept in by.get(k, [])):
            continue
        for kept in by.setdefault(k, []):
            if s not in kept["s"]:
                kept["s"].add(s), kept["m"].append((s, sid))
                break
        else:
            row = {"ord": o, "s": {s}, "m": [(s, sid)]}
            by[k].append(row), out.append(row)
    got = {r.ord: [(m.source, m.sid) for m in r.members] for r in R.dedup_cross_source(_jobs(spark, rows)).collect()}
    assert got == {r["ord"]: r["m"] for r in out}


def test_suppression_equals_loop(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), f"u{i}", rnd.choice(["k1", "k2", None]), rnd.random() < 0.3) for i in range(120)]
    owner, want = {}, {}
    for o, s, u, k, masked in rows:
        first = owner.setdefault(k, (s, u)) if k else None
        want[o] = first[1] if first and first[1] != u and (masked or s != first[0]) else None
    df = spark.createDataFrame(rows, "ord long, source string, url string, k string, masked boolean")
    assert {r.ord: r.blocked_by for r in R.suppress_within_run(df, "k", F.col("masked")).collect()} == want


def test_caps_and_budgets(spark):
    df = spark.range(20).select(F.col("id").alias("ord"), (F.col("id") % 5 == 0).alias("keep"))
    kept = {r.ord for r in R.cap_protected(df, F.col("keep"), 10, [F.col("ord").desc()]).collect()}
    assert kept == {0, 5, 10, 15, 14, 16, 17, 18, 19, 13}
    assert R.cap_protected(df, F.lit(True), 3, ["ord"]).count() == 20  # protected rows all stay
    d = spark.createDataFrame([("g", i, n) for i, n in enumerate((500, 10, 10))], "g string, ord int, n int")
    assert [r.ord for r in R.budget_prefix(d, ["g"], ["ord"], F.col("n"), 100, 12).collect()] == [0]


def test_empty_key_rows_stay(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a"), (4, "a")], "ord int, k string")
    assert sorted(r.ord for r in R.first_per_key(df, F.col("k"), ["ord"]).collect()) == [1, 2, 3]


def test_finish_bucket_fates(spark):
    rows = spark.createDataFrame([(1, "u1", "a"), (2, "u1/", "a"), (3, "", "b"), (4, "u4", "b"), (5, "u5", "b")], "ord int, url string, reason string")
    drops = [("on-page", spark.createDataFrame([("u4",)], "url string"))]
    got = {r.ord: r.fate for r in B.finish_bucket(rows, drops, 2, [F.col("ord")]).collect()}
    assert got == {1: "kept", 2: "dup-url", 3: "kept", 4: "on-page", 5: "cap"}


def test_source_health_states(spark):
    counts = spark.createDataFrame([("a", 0), ("b", 2), ("c", 9), ("d", -1), ("n", 0)], "source string, n long")
    stats = spark.createDataFrame([("a", 10, 0), ("b", 10, 0), ("c", 10, 0), ("d", 7, 1), ("n", 0, 2)], "source string, best long, zero_runs int")
    assert {r.source: r.state for r in B.source_health(counts, stats).collect()} == {"a": "dark", "b": "partial", "c": "ok", "d": "dark", "n": "never"}


def test_ttl_boundary(spark):
    df = spark.createDataFrame([("2026-01-01",), ("2026-01-31",), ("bad",), (None,)], "seen string")
    assert [r.e for r in df.select(ST.expired(F.col("seen"), "2026-02-01").alias("e")).collect()] == [True, False, False, False]


def test_soft_block_city_exemption(spark):
    reg = spark.createDataFrame([("k", "2026-01-20", "u0", "s", "haifa")], "k string, seen string, u string, src string, city string")
    jobs = spark.createDataFrame([(1, "s", "haifa", "k", None), (2, "s", "akko", "k", None), (3, "t", "akko", "k", None), (4, "s", "x", None, "k")], "ord int, source string, city_key string, soft string, legacy string")
    assert {r.ord: r.blocked_by for r in ST.soft_block(jobs, reg, "2026-02-01").collect()} == {1: "u0", 2: None, 3: "u0", 4: None}


def test_state_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "state")
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    assert ST.read_state(spark, path, df.schema).count() == 0  # a missing table is a fresh start
    ST.replace_table(df, path)
    ST.replace_table(df.union(df), path)
    assert ST.read_state(spark, path, df.schema).count() == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["state"]


def test_retry_queue(spark):
    q = spark.createDataFrame([(1, "2026-01-01")], "ord int, queued string")
    s = spark.createDataFrame([(2, "2026-01-30")], "ord int, queued string")
    assert ST.retry_queue(q, s, s, True, "2026-02-01").count() == 0
    assert [r.ord for r in ST.retry_queue(q, s, s.limit(0), False, "2026-02-01").collect()] == [2]  # the old one expired


def test_collapse_idempotent(spark):
    rows = [
        (1, "Acme", "Senior Data Engineer", "https://hirevane.example/jobs/1", None, "North", "YES", 80, False), (2, "Acme", "Senior data engineer", "https://careers.acme.example/2", [("https://hirevane.example/jobs/1", "", "")], "North", "", None, True),
        (3, "Acme", "Senior Data Engineer", "https://careers.acme.example/3", None, "Center", "", None, False), (4, "Bolt", "Dev", "https://x.example/4", None, "", "", None, False),
    ]
    df = spark.createDataFrame(rows, "row_id long, company string, role string, url string, dups array<struct<url:string,src:string,region:string>>, region string, verdict string, match int, important boolean").withColumn("orig", F.lit(None).cast("string"))
    got = {r.row_id: sorted(r.merged) for r in CO.collapse_copies(df).collect()}
    assert sum(map(len, got.values())) == 3 and all(4 not in m for m in got.values())
    # kept rows carry the links they took over
    kept = CO.collapse_copies(df).select("row_id", F.transform("urls", lambda u: F.struct(u.alias("url"), F.lit("").alias("src"), F.lit("").alias("region"))).alias("dups"))
    again = df.drop("dups").join(kept, "row_id")
    assert {r.row_id for r in CO.collapse_copies(again).collect()} == set(got)


def test_page_pinned_rows_pass(spark):
    df = spark.createDataFrame([(1, "a", "x", "North", 10, "NO", True, 3, "d"), (2, "a", "x", "North", 90, "YES", False, 3, "d"), (3, "a", "x", "South", 90, "YES", False, 3, "d")],
                               "row_id long, company string, role string, region string, match int, verdict string, important boolean, fit int, pull_date string")
    assert [r.row_id for r in O.page_query(df, regions=("North",), least_match=50, verdicts=("YES",)).orderBy("rank").collect()] == [1, 2]


def test_publication_refuses(spark):
    df = spark.createDataFrame([(1, "a</b>")], "row_id int, role string")
    with pytest.raises(AssertionError):
        P.self_check(df, ["row_id"], F.lit(False))
    with pytest.raises(AssertionError):
        P.self_check(df, ["row_id", "role"], F.col("row_id") == 1)
    with pytest.raises(ValueError):
        O.sanitized(df, ["row_id"], ())
    assert "<\\/b>" in P.render_page(df, "<t>{{title}}</t>{{data}}", {"title": "x"})


def test_delivery_stops_at_failure(spark):
    rows = spark.createDataFrame([(i, i // 2, f"l{i}") for i in range(6)], "rn int, message int, l string")
    answers = iter([True, False])
    got = {(r.message, r.sent) for r in P.deliver(rows, F.col("l"), lambda t: next(answers)).collect()}
    assert got == {(0, True), (1, False), (2, False)}


def test_classify_ladder(spark):
    base = {"source": "s", "sid": "1", "city": "", "url": "", "level": "", "years_max": None, "tech": [], "active": True, "region": "North"}
    rows = [("Junior Data Engineer", "X", 1, "apply"), ("Data Engineer", "X", 3, "reach"), ("Senior Data Engineer", "X", None, "skip"), ("Gardener", "X", None, None), ("Data Engineer", "X", None, "review"), ("Student Data Engineer", "X", None, "skip"), ("Data Engineer", "Orzurel", None, "reach"), (None, None, None, None)]
    df = spark.createDataFrame([(i, *base.values(), t, c, y, "a text " * 20) for i, (t, c, y, _) in enumerate(rows)], "ord int, source string, sid string, city string, url string, level string, years_max int, tech array<string>, active boolean, region string, title string, company string, years_min int, desc string")
    assert [r.lane for r in C.classify(C.facts(C.normalize(df))).orderBy("ord").collect()] == [w for *_, w in rows]
