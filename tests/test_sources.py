import json
import sqlite3

from pyspark.sql import functions as F

from pagewright.operators import api
from pagewright.sources import files, web
from pagewright.sources.sqlite import SqliteSource, write_upsert
from pagewright.streaming.metrics import hourly


def test_json_and_encodings(spark, tmp_path):
    rows = [{"url": "u1", "title": "é", "is_personal": 1}, {"url": "u2", "extra": 1}]
    (tmp_path / "a.json").write_text(json.dumps(rows), encoding="utf-8")
    df = files.read_documents(spark, str(tmp_path / "a.json"))
    assert [(r.url, r.title, r.content) for r in df.orderBy("url").collect()] == [("u1", "é", None), ("u2", None, None)]
    yes, no = files.read_prototypes(spark, str(tmp_path / "a.json"))
    assert (yes.count(), no.count()) == (1, 1)
    (tmp_path / "e").mkdir()
    (tmp_path / "e/utf8.json").write_bytes(json.dumps(rows, ensure_ascii=False).encode("utf-8"))
    (tmp_path / "e/bom.json").write_bytes(json.dumps(rows, ensure_ascii=False).encode("utf-8-sig"))
    (tmp_path / "e/latin.json").write_bytes(json.dumps(rows, ensure_ascii=False).encode("latin-1"))
    (tmp_path / "e/broken.json").write_bytes(b"{")
    got = {(r.path.rsplit("/", 1)[1], r.encoding, r.title) for r in files.read_any_encoding(spark, str(tmp_path / "e")).filter("url = 'u1'").collect()}
    assert got == {("utf8.json", "utf-8", "é"), ("bom.json", "utf-8-sig", "é"), ("latin.json", "latin-1", "é")}


def test_taxonomy_seeds_feeds(spark, tmp_path):
    t = {"domain_patterns": {"good": {"patterns": ["a", "b"], "weight": 5}}, "content_indicators": {"positive_regex": {"p": {"patterns": ["x"], "weight": 1}}, "negative_regex": {}}}
    (tmp_path / "t.json").write_text(json.dumps(t, indent=1))
    got = {(r.scope, r.category, r.ord, r.pattern, r.weight) for r in files.read_taxonomy(spark, str(tmp_path / "t.json")).collect()}
    assert got == {("domain", "good", 0, "a", 5), ("domain", "good", 1, "b", 5), ("content", "p", 0, "x", 1)}
    (tmp_path / "s.json").write_text(json.dumps(["u1", "u2", "u3", "u4"]))
    assert [r.url for r in files.read_seeds(spark, str(tmp_path / "s.json")).collect()] == ["u1", "u2", "u3"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.xml").write_text("<rss><channel><link>no</link><item><link>l1</link></item><item><link><![CDATA[l2]]></link></item><item><link>l3</link></item></channel></rss>")
    (tmp_path / "f/b.xml").write_text('<feed><entry><link rel="x" href="l4"/></entry></feed>')
    assert sorted(r.link for r in files.feed_items(spark, str(tmp_path / "f"), 2).collect()) == ["l1", "l2", "l4"]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "c.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE pages (url TEXT PRIMARY KEY, status INTEGER, content TEXT)")
        c.executemany("INSERT INTO pages VALUES (?, ?, ?)", [(f"u{i}", i, None if i == 3 else "x" * i) for i in range(10)])
        c.execute("CREATE TABLE empty (a INTEGER)")
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite").options(path=path, table="pages", partitions=3).load()
    assert df.dtypes == [("url", "string"), ("status", "bigint"), ("content", "string")]
    assert df.count() == 10 and df.filter("content is not null and content != ''").count() == 8
    assert spark.read.format("sqlite").options(path=path, table="empty").load().count() == 0
    write_upsert(iter([{"url": "u1", "status": 5, "content": "new"}, {"url": "z", "status": 1, "content": None}]), path, "pages", "url", ["url", "status", "content"])
    got = {r.url: r.content for r in spark.read.format("sqlite").options(path=path, table="pages").load().collect()}
    assert got["u1"] == "new" and len(got) == 11


def test_fetch(spark):
    pages = {"http://a.example/robots.txt": (200, "User-agent: *\nDisallow: /no"), "http://a.example/x": (200, "<title>T</title>"), "http://b.example/y": (500, "")}

    def fetch(url):
        if url not in pages:
            raise OSError("gone")
        return pages[url]

    urls = spark.createDataFrame([(u,) for u in ("http://a.example/x", "http://a.example/no", "http://b.example/y", "http://c.example/", None)], "url string")
    got = web.fetched(urls, fetch, 2, 0.0).collect()
    assert [(r.url, r.title, r.status_code) for r in got] == [("http://a.example/x", "T", 200)]


def test_stores(spark, tmp_path):
    v = spark.createDataFrame([(1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    p = str(tmp_path / "v")
    assert files.load_or_create(spark, p, lambda: v).count() == 1
    assert files.load_or_create(spark, p, lambda: v.limit(0)).count() == 1
    files.write_prototype_store(v, {"threshold": 0.7}, str(tmp_path / "ps"))
    got, params = files.read_prototype_store(spark, str(tmp_path / "ps"))
    assert got.first().embedding == [0.5, 0.5] and params == {"threshold": 0.7}
    files.write_index(v, str(tmp_path / "i"))
    files.write_index(v, str(tmp_path / "i"), "append")
    assert spark.read.parquet(str(tmp_path / "i")).count() == 2


def test_service(spark, data):
    docs = spark.read.parquet(f"{data}/search_index.parquet")
    log = spark.read.parquet(f"{data}/search_log.parquet")
    r = api.search_response(docs, "notes", limit=5).collect()
    assert len(r) == 5 and r[0].position == 1 and {x.search_strategy for x in r} == {"basic_only"}
    assert api.health(docs, log).first().status == "healthy"
    assert api.metrics(log).first().total == log.count()
    assert api.domains(docs).count() > 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2026-01-01 0{i % 4}:10:00", i % 3 > 0, float(i)) for i in range(20)] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, "event_id long, t string, success boolean, search_time_ms double").withColumn("searched_at", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "log"))
    got = hourly(spark.read.parquet(str(tmp_path / "log")))
    assert {(r.searches, r.failed) for r in got.collect()} <= {(5, 1), (5, 2)} and got.count() == 4
