import pytest
from pyspark.sql import functions as F

from quillmill.operators.triage import Keywords
from quillmill.sources import feeds, imports, records
from quillmill.streaming import jobs

RSS = """﻿junk<?xml version="1.0"?><rss version="2.0"><channel><title>c</title><item><title>One &amp; two</title><link>https://a.org/1?a=1&b=2</link><guid>g1</guid><dc:creator>Ann</dc:creator><pubDate>Wed, 02 Oct 2002 13:00:00 GMT</pubDate>
<description>&lt;p&gt;Hello&lt;/p&gt;</description><category>x</category><category>y</category></item><item><guid>https://a.org/2</guid></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="self" href="https://a.org/self"/><link href="https://a.org/3"/><id>i3</id><author><name>Bob</name></author><updated>2024-01-05T10:00:00Z</updated><summary>S</summary><category term="z"/></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="x"><item rdf:about="https://a.org/4"><title>R</title><link>https://a.org/4</link><dc:date>2024-01-06</dc:date><description>D</description></item></rdf:RDF>"""


def test_three_dialects(spark):
    docs = spark.createDataFrame([("rss", RSS), ("atom", ATOM), ("rdf", RDF), ("bad", "<html>"), ("none", None)], "source_id string, xml string")
    got = {(r.source_id, r.pos): r for r in feeds.explode_feeds(docs).collect()}
    assert set(got) == {("rss", 0), ("rss", 1), ("atom", 0), ("rdf", 0)}
    a, b, c, d = got["rss", 0], got["rss", 1], got["atom", 0], got["rdf", 0]
    assert (a.title, a.url, a.author, str(a.published_at), a.summary, a.tags) == ("One & two", "https://a.org/1?a=1&b=2", "Ann", "2002-10-02", "Hello", ["x", "y"])
    assert (b.title, b.url, b.guid) == ("(untitled)", "https://a.org/2", "https://a.org/2")
    assert (c.title, c.url, c.guid, c.author, str(c.published_at), c.summary, c.tags) == ("T", "https://a.org/3", "i3", "Bob", "2024-01-05", "S", ["z"])
    assert (d.title, d.url, str(d.published_at), d.summary) == ("R", "https://a.org/4", "2024-01-06", "D")


def test_records(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1", "v": 2}\n\nbroken\n{"id": "2"}\n')
    path = f"{tmp_path}/x.jsonl"
    assert sorted(tuple(r) for r in records.read_records(spark, path, "id string, v int").collect()) == [("1", 2), ("2", None)]
    assert [r.line for r in records.bad_records(spark, path, "id string, v int").collect()] == ["broken"]
    with pytest.raises(Exception, match="(?i)malformed|corrupt|FAILFAST"):
        records.read_records(spark, path, "id string, v int", strict=True).collect()
    assert records.read_records(spark, f"{tmp_path}/none.jsonl", "id string").count() == 0
    df = spark.createDataFrame([("1", "open"), ("2", "local")], "id string, track string")
    records.write_records(df, f"{tmp_path}/t", partition_by=["track"])
    records.write_records(df, f"{tmp_path}/t", mode="append", partition_by=["track"])
    assert spark.read.parquet(f"{tmp_path}/t").filter("track = 'open'").count() == 2
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert records.load_config(spark, f"{tmp_path}/c.json", {}) == {"a": 1} and records.load_config(spark, f"{tmp_path}/d.json", {"b": 2}) == {"b": 2}


def test_export(spark):
    items = spark.createDataFrame([("i1", ["a"])], "id string, tags array<string>")
    events = spark.createDataFrame([("e1", "i1", "x"), ("e2", "gone", "x"), ("e3", "i1", "manual-seed")], "id string, item_id string, reviewer string")
    out = records.export_tables(items, items, events, items)
    assert out["items"].first().tags_json == '["a"]' and [r.id for r in out["review_events"].collect()] == ["e1"]


def test_imports(spark):
    lists = [("open", ["open source"]), ("local", ["museum"])]
    e = spark.createDataFrame(
        [("T open source", [("https://a.org/1",)], None, 1700000000, "s", ["user/-/label/L", "user/-/state/x"], ("feed/https://a.org/f", "https://a.org", "A")), ("M museum", None, [("https://b.org/1",)], 1700000000, "s", None, ("feed/https://new.org/f", "https://new.org", "N"))],
        "title string, canonical array<struct<href:string>>, alternate array<struct<href:string>>, published long, summary string, categories array<string>, origin struct<streamId:string,htmlUrl:string,title:string>",
    )
    sources = spark.createDataFrame([("s1", "https://a.org/f", "https://a.org")], "id string, feed_url string, site_url string")
    items, added = imports.import_starred(e, sources, lists, "now")
    rows = {r.title: r for r in items.collect()}
    assert rows["T open source"].source_id == "s1" and rows["T open source"].tags == ["L"] and rows["T open source"].track == "open" and rows["M museum"].track == "local" and rows["M museum"].url == "https://b.org/1"
    assert [r.feed_url for r in added.collect()] == ["https://new.org/f"]
    subs = imports.import_subscriptions(spark.createDataFrame([(["G", "H"], "Open source feed", "https://x/f", "https://x")], "group_path array<string>, title string, xml_url string, html_url string"), lists).first()
    assert (subs.source_group, subs.track, subs.source_type) == ("G / H", "open", "rss")
    sheet = imports.import_sheet_rows(spark.createDataFrame([("S", 1, {"Name": "N", "Link": "", "Note": "see https://c.org/x"}), ("S", 2, {"Name": "only"})], "sheet string, row_no int, cells map<string,string>"), {"title": ["Title", "Name"], "url": ["Link"]}, lists, "now").collect()
    assert [(r.title, r.url, r.origin) for r in sheet] == [("N", "https://c.org/x", "xlsx:S")]


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01", "s", "accepted"), ("a", "2024-01-02", "s", "rejected"), ("b", "2024-01-03", "t", "pending")], "key string, at string, source_id string, outcome string").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    assert sorted(r.key for r in drain(jobs.dedup_stream(stream), "dedup").collect()) == ["a", "b"]
    rolled = drain(jobs.rolling_outcomes(stream), "rolled", "complete")
    assert sorted(tuple(r) for r in rolled.collect()) == sorted(tuple(r) for r in jobs.rolling_outcomes(df).collect())
    items = spark.createDataFrame([("1", "open", "alpha")], "id string, track string, title string")
    items.write.parquet(f"{tmp_path}/items")
    jobs.triage_to_table(spark.readStream.schema(items.schema).parquet(f"{tmp_path}/items"), {"open": Keywords(keep=("alpha",))}, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").first().triage.recommendation == "suggest-keep"


def test_cooldown(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-03"), ("a", "2024-01-09"), ("b", "2024-01-02")], "id string, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    out = drain(jobs.cooled_down(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), "cooled")
    assert sorted((r.id, str(r.at)[:10], r.attempt) for r in out.collect()) == [("a", "2024-01-01", 1), ("a", "2024-01-09", 2), ("b", "2024-01-02", 1)]


def test_entries_by_all_keys_against_earlier_batches(spark, tmp_path):
    batches = [
        [("a", ["id:1", "url:x"], "2024-01-01"), ("b", ["url:x", "guid:2"], "2024-01-02"), ("n", [], "2024-01-02")],
        [("c", ["guid:2"], "2024-01-03"), ("d", ["id:1", "url:y"], "2024-01-03"), ("f", None, "2024-01-03"), ("g", ["url:y"], "2024-01-04")],
        [("e", ["id:1"], "2024-09-01"), ("h", ["guid:2", "id:1"], "2024-09-02")],
    ]
    want = [{"a", "n"}, {"a", "n", "c", "f", "g"}, {"a", "n", "c", "f", "g", "e"}]
    for rows, found in zip(batches, want, strict=True):
        df = spark.createDataFrame(rows, "name string, keys array<string>, at string").withColumn("at", F.col("at").cast("timestamp"))
        df.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        query = jobs.dedup_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/cp", ["at", "name"])
        assert query.awaitTermination(120)
        assert {r.name for r in spark.read.parquet(f"{tmp_path}/out").collect()} == found
