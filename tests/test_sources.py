"""Adapters over small landed payloads."""

import json

from pyspark.sql import functions as F

from sievework.sources import boards
from sievework.sources import feeds as S
from sievework.streaming import fronts as ST


def test_json_feed(spark, tmp_path):
    items = [{"id": i, "t": f"1234{i} - Dev {i}", "loc": ["Haifa", "Paris"][i % 2], "d": "<p>5+ years<br>of python</p>", "up": i} for i in (1, 2, 2, 3)]
    (tmp_path / "p1.json").write_text(json.dumps({"jobs": items}))
    (tmp_path / "bad.json").write_text("{")
    feed = S.Feed("acme", str(tmp_path / "*.json"), schema="jobs array<struct<id:long,t:string,loc:string,d:string,up:long>>", items="d.jobs", fields={"sid": "item.id", "title": "item.t", "city": "item.loc", "desc": "item.d", "updated": "item.up"}, company="Acme", html_desc=True, steps=(S.any_place("paris"), S.newest(5)))
    rows = S.read_feed(spark, feed).orderBy("sid").collect()
    assert [(r.sid, r.title, r.company, r.years_min, r.tech) for r in rows] == [("1", "Dev 1", "Acme", 5, ["python"]), ("3", "Dev 3", "Acme", 5, ["python"])]


def test_html_cards_and_script(spark, tmp_path):
    (tmp_path / "a.html").write_text('<div class="c" id="7"><b>Junior Dev</b><i>Haifa</i></div><div class="c" id="8"><b>Ops</b><i></i></div><script id="state">{"list":[{"k":"9","n":"Lead Dev"}]};</script>')
    cards = S.Feed("cards", str(tmp_path / "a.html"), kind="html", items=r'(?s)<div class="c".*?</div>', fields={"sid": r'id="(\d+)"', "title": "<b>(.*?)</b>", "city": "<i>(.*?)</i>"}, cap=1)
    assert [(r.sid, r.level) for r in S.read_feed(spark, cards).collect()] == [("7", "junior")]
    script = S.Feed("script", str(tmp_path / "a.html"), kind="script", opening=r'<script id="state">', schema="list array<struct<k:string,n:string>>", items="d.list", fields={"sid": "item.k", "title": "item.n"})
    assert [(r.sid, r.level) for r in S.read_feed(spark, script).collect()] == [("9", "lead")]


def test_xml_items_and_names(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<r><item><guid>1</guid><title>Dev</title></item><item><guid>2</guid><title>Ops</title></item></r>")
    feed = S.Feed("rss", str(tmp_path / "m.xml"), kind="xml", schema="guid string, title string", items="item", fields={"sid": "item.guid", "title": "item.title"}, steps=(S.title_gate("dev"),))
    assert [r.sid for r in S.read_feed(spark, feed).collect()] == ["1"]
    (tmp_path / "names.txt").write_text("acme # old\n\n# none\nbolt\n")
    assert sorted(r.name for r in S.name_list(spark, str(tmp_path / "names.txt")).collect()) == ["acme", "bolt"]


def test_pages_count_by_name_and_stop_at_a_repeat(spark, tmp_path):
    page = lambda n, *ids: (tmp_path / f"p{n}.json").write_text(json.dumps({"jobs": [{"id": i} for i in ids]}))
    page(1, 11, 12), page(2, 21), page(3, 11, 21), page(4, 41), page(5, 51)
    feed = lambda **k: S.Feed("a", str(tmp_path / "*.json"), schema="jobs array<struct<id:long>>", items="d.jobs", fields={"sid": "item.id"}, **k)
    read = lambda f: [r.sid for r in S.read_feed(spark, f).orderBy("ord").collect()]
    assert read(feed()) == ["11", "12", "21", "41", "51"] and read(feed(cap=2)) == ["11", "12"]
    assert read(feed(stop_on_repeat=True)) == ["11", "12", "21"]


def test_best_places_and_validated(spark):
    df = spark.createDataFrame([("s", "1", "Velograd; Haifa; Acre; Lod"), ("s", "2", "Velograd"), ("s", "3", "")], "source string, sid string, city string")
    rank = F.when(F.col("place") == "Acre", 0).when(F.col("place").isin("Haifa", "Lod"), 1)
    assert {r.sid: r.city for r in S.best_places(rank, 2)(df).collect()} == {"1": "Acre / Haifa", "2": "", "3": ""}
    good = F.col("city").contains("Haifa")
    assert S.validated([df, df.filter("sid = '1'")], good).count() == 1 and S.validated([df.filter("sid = '2'")], good).count() == 0


def test_steps(spark):
    df = spark.createDataFrame([("1", "Springfield, IL, US", "s", 1, "x"), ("2", "Haifa, IL", "s", 2, "y")], "sid string, city string, source string, ord int, desc string")
    assert [r.sid for r in S.last_country("IL")(df).collect()] == ["2"]
    details = spark.createDataFrame([("1", "a longer text"), ("2", "a longer text")], "sid string, desc string")
    assert {r.sid: r.desc for r in S.with_details(details, 1)(df).collect()} == {"1": "a longer text", "2": "y"}


def test_collect_counts_failures(spark):
    ok = lambda s: s.createDataFrame([("a", "1", "t", "c", "", "", "", None, None, [], "", True, 1)], S.POSTING)

    def broken(s):
        raise OSError("no network")

    rows, yields = S.collect(spark, ["ok", "broken", "missing"], {"ok": ok, "broken": broken})
    assert rows.count() == 1
    assert {r.source: r.n for r in yields.collect()} == {"ok": 1, "broken": -1}


def test_board_source(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"items": [{"id": 1}, {"id": 2}]}')
    (tmp_path / "b.json").write_text("nonsense")
    boards.register(spark)
    rows = spark.read.format("landed_boards").option("path", str(tmp_path)).load()
    got = rows.groupBy("board").agg(F.count("item").alias("n"), F.max("error").isNotNull().alias("bad")).collect()
    assert {(r.board, r.n, r.bad) for r in got} == {("a", 2, False), ("b", 0, True)}


def test_stream_registry(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    schema = "ord long, source string, url string, city_key string, soft string, legacy string"
    for i, src in enumerate(("a", "b")):
        spark.createDataFrame([(i, src, f"u{i}", "x", "k", None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ST.stream_registry(jobs, str(tmp_path / "state"), str(tmp_path / "out"), "2026-02-01", str(tmp_path / "q")).awaitTermination()
    assert {r.ord: r.blocked_by for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: None, 1: "u0"}
