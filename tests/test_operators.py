import math
import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import classify, crawl, index, ingest, learn, reports, vectors
from pagewright.operators.rows import global_rank, keep_first, moving_average, page_of

DOCS = [
    (1, "https://a.example/1", "The quick Notes", "a.example", "x"),
    (2, "https://b.example/2", "notes, the end", "B.example", None),
    (3, "https://a.example/3", None, "a.example", ""),
    (4, "https://c.example/4", "notes notes the THE", None, "y"),
    (4, "https://c.example/4", "notes notes the THE", None, "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_idx long, url string, title string, domain string, content string")


def ids(df):
    return [r.doc_idx for r in df.collect()]


def test_search(docs):
    assert ids(index.search(docs, "NOTES the")) == [1, 4, 4]
    assert ids(index.search(docs, "a of")) == []
    assert ids(index.search(docs, "notes", domain="A.EXAMPLE")) == [1]
    assert ids(index.search(docs, "notes", domain="none.example")) == [1, 4, 4]
    assert ids(index.search(docs, "notes", domain="none.example", strict_domain=True)) == []
    assert ids(index.search(docs, "notes", limit=1, page=2)) == [4]
    assert ids(index.search(docs, "notes", limit=2, page=9)) == []
    for bad in ({"limit": 0}, {"page": 0}):
        with pytest.raises(ValueError):
            index.search(docs, "notes", **bad)
    assert index.page_links(1, 9) == [1, 2, 3] and index.page_links(9, 9) == [7, 8, 9]


def test_index_search_equals_scan(spark, docs):
    posts = index.postings(docs, "doc_idx", "title")
    for q in ("notes the", "quick", "nothing", ""):
        assert sorted(ids(index.matching_by_index(posts, docs, q, "doc_idx"))) == sorted(ids(index.matching(docs, q)))


def test_pages_make_the_whole(spark):
    df = spark.range(57).withColumnRenamed("id", "doc_idx")
    seen = [x for p in range(1, 8) for x in ids(page_of(df, [F.desc("doc_idx")], p, 9))]
    assert seen == list(range(56, -1, -1))


def test_keep_first_ties_and_clashing_names(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "y"), (None, 3, None)], "k string, _rn int, `first.row` string")
    got = {tuple(r) for r in keep_first(df, ["k"], [F.col("_rn"), F.col("`first.row`")]).collect()}
    assert got == {("a", 1, "y"), (None, 3, None)}


def test_rank_and_moving_average(spark):
    random.seed(3)
    v = [(i, random.randint(0, 99)) for i in range(500)]
    df = spark.createDataFrame(random.sample(v, 500), "seq long, v long").repartition(7)
    assert [(r["rank"], r.seq) for r in global_rank(df, ["seq"]).orderBy("rank").collect()] == [(i + 1, i) for i in range(500)]
    got = {r.seq: r.moving_average for r in moving_average(df, "v", ["seq"], 20, block=50).collect()}
    for i in range(500):
        w = [x for _, x in v[max(0, i - 19) : i + 1]]
        assert math.isclose(got[i], sum(w) / len(w))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert ids(index.search(none, "notes")) == []
    assert index.search_summary(none, "notes").first().total_results == 0
    assert keep_first(none, ["url"], [F.col("doc_idx")]).count() == 0
    assert reports.quality(none.withColumn("confidence", F.lit(1.0))).first().docs == 0
    assert reports.progress(none).first().remaining == 1000


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 0), (3, [1.0, 0.0], 0), (4, None, 1)], "vec_id long, embedding array<float>, label int")
    top = vectors.top_k(v, [1.0, 0.0], 2)
    assert [r.vec_id for r in top.collect()] == [1, 3]
    m = {r.vec_id: (r.personal, r.corporate) for r in vectors.class_maxima(v, v.filter("embedding is not null")).collect()}
    assert m[1] == (1.0, 1.0) and m[2] == (0.0, 1.0) and 4 not in m
    d = v.limit(1).select(vectors.prototype_decision(F.lit(0.9), F.lit(0.9)).alias("a"), vectors.prototype_decision(F.lit(0.5), F.lit(0.1)).alias("b")).first()
    assert (d.a.prediction, d.b.prediction, d.b.confidence) == (0, None, 0.5)
    alone = vectors.class_maxima(v.filter("vec_id < 3"), v.filter("vec_id < 3"), leave_one_out=True).filter("vec_id = 2").first()
    assert alone.personal == 0.0


def test_encoder(spark):
    enc = vectors.hashing_encoder(16)
    rows = spark.createDataFrame([("a b",), ("",), (None,)], "t string").select(enc("t").alias("v")).collect()
    assert math.isclose(sum(x * x for x in rows[0].v), 1, rel_tol=1e-5) and set(rows[1].v) == {0.0} == set(rows[2].v)


def test_hybrid_and_fallback(spark):
    kw = spark.createDataFrame([("u1",), ("u2",)], "url string")
    sem = spark.createDataFrame([("u2", 0.9), ("u3", 0.8), ("u3", 0.2)], "url string, semantic_score double")
    got = [(r.url, round(r.hybrid_score, 3)) for r in vectors.hybrid(kw, sem, 5).collect()]
    assert got == [("u3", 0.56), ("u2", 0.27), ("u1", 0.0)]
    basic = spark.createDataFrame([("http://a.example/", 1), ("http://www.a.example", 2)], "url string, pos long")
    more = spark.createDataFrame([("http://a.example/#x", 1), ("http://b.example", 2)], "url string, pos long")
    assert [r.url for r in vectors.fallback_merge(basic, more, 10).collect()] == ["http://a.example/", "http://b.example"]
    assert [r.url for r in vectors.fallback_merge(basic, more, 2).collect()] == ["http://a.example/"]


def test_cascade(spark):
    s = "struct<prediction:int,confidence:double>"
    df = spark.createDataFrame(
        [(1, (1, 0.9), None, None, None), (2, (0, 0.3), None, (1, 0.8), (0, 0.9)), (3, (0, 0.3), None, (1, 0.6), (1, 0.6)), (4, None, None, None, None)],
        f"k int, domain {s}, tfidf {s}, embedding {s}, structural {s}",
    )
    got = {r.k: (r.is_personal, r.stage_used) for r in classify.cascade(df, "k").collect()}
    assert got == {1: (1, "weighted_vote"), 2: (1, "embedding"), 3: (1, "structural"), 4: (None, "weighted_vote")}
    assert {r.k: r.stage_used for r in classify.cascade(df, "k", classify.INTENDED).collect()}[1] == "domain"


def test_ingest(spark):
    new = spark.createDataFrame([("https://A.example/x/?q=1", 1), ("https://a.example/x", 2), ("https://b.example/", 3), (None, 4)], "url string, pos int")
    old = spark.createDataFrame([("https://b.example#f",), (None,)], "url string")
    assert [(r.url, r.pos) for r in ingest.new_urls(new, old).collect()] == [("https://A.example/x/?q=1", 1)]
    a = spark.createDataFrame([("u", 1, "old"), ("v", None, "kept")], "url string, ts int, v string")
    b = spark.createDataFrame([("u", 2, 7), ("w", 1, 8)], "url string, ts int, extra int")
    got = {r.url: (r.ts, r.v, r.extra) for r in ingest.upsert(a, b, "url", ["ts"]).collect()}
    assert got == {"u": (2, None, 7), "v": (None, "kept", None), "w": (1, None, 8)}


def test_crawl_order(spark):
    links = {"s": ["c", "a", "b"], "a": ["d", "s"], "b": ["e"], "c": ["f"], "d": [], "e": ["a"], "f": None, "x": ["s"]}
    pages = spark.createDataFrame(list(links.items()), "url string, links array<string>")
    seeds = spark.createDataFrame([("s",), ("missing",)], "url string")

    def brute(limit, per):
        queue, seen, out = ["s"], set(), []
        while queue and len(out) < limit:
            u = queue.pop(0)
            if u in seen or u not in links:
                continue
            seen.add(u)
            out.append(u)
            queue += sorted(set(links[u] or []))[:per]
        return out

    for limit, per in ((50, 5), (4, 5), (50, 2)):
        got = [r.url for r in crawl.crawl_order(pages, seeds, limit, per).orderBy("position").collect()]
        assert got == brute(limit, per)


def test_links_of_subpages(spark):
    rows = [
        (1, "https://a.example/", '<a href="/about">Me</a> <a href="/fav">Favorite reads</a> <a href="/x">x</a>'),
        (2, "https://a.example/about", '<a href="https://b.example/">my other blog</a> <a href="https://c.example/">shop</a>'),
        (3, "https://a.example/fav", '<a href="https://d.example/">d</a> <a href="/about">about</a>'),
        (4, "https://a.example/x", None),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html_content string")
    about = {tuple(r) for r in crawl.links_of_subpages(pages, "about", crawl.ABOUT_TEXTS).collect()}
    assert about == {(1, "https://b.example/"), (3, "https://b.example/")}
    assert {tuple(r) for r in crawl.links_of_subpages(pages, "favorites?|reading|/fav").collect()} == {(1, "https://d.example/")}


def test_validation(spark):
    rows = [(1, 1)] * 3 + [(0, 1)] * 2 + [(1, 0)] + [(0, 0)] * 4 + [(None, None)]
    r = reports.validation(spark.createDataFrame(rows, "t int, p int"), "t", "p").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (3, 2, 1, 5) and r.precision == 0.6 and r.recall == r.legacy_precision == 0.75


def test_learn(spark):
    rows = [(f"i love my garden notes {w}", 1) for w in "abcdef"] + [(f"buy our enterprise platform {w}", 0) for w in "abcdef"]
    df = spark.createDataFrame(rows, "text string, label int")
    model = learn.train(df)
    probe = spark.createDataFrame([(1, "my garden notes"), (2, "enterprise platform"), (3, ""), (4, None)], "k int, text string")
    got = {r.k: (r.prediction, r.confidence) for r in learn.predict(model, probe, "k").collect()}
    assert got[1][0] == 1 and got[2][0] == 0 and got[3] == got[4] == (0, 0.0) and got[1][1] > 0.5
    assert learn.train(df.limit(4)) is None
    assert {r.prediction for r in learn.predict(None, probe, "k").collect()} == {0}
