"""Queries that SQL cannot say, against brute force; composed pipelines on odd rows; stores."""

from collections import Counter, deque
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagewright.functions import urls as U
from pagewright.operators import classify, crawl, ingest, learn, vectors
from pagewright.operators.rows import quantiles
from pagewright.plans import registry
from pagewright.plans.runtime import table
from pagewright.sources import files

Q = registry.queries()


def test_crawl_equals_a_queue(spark, data):
    pages = table(spark, data, "crawled_pages")
    links = crawl.outgoing_links(pages).join(pages.select("page_id", U.canonical_domain(F.col("url")).alias("host")), "page_id")
    graph = {}
    for r in links.select("host", U.canonical_domain(F.col("link")).alias("to")).distinct().collect():
        graph.setdefault(r.host, set()).add(r.to)
    seeds = sorted(graph)[:3]
    seen, queue, order = set(seeds), deque(seeds), []
    while queue and len(order) < 100:
        u = queue.popleft()
        order.append(u)
        for v in sorted(graph[u])[:5]:
            if v in graph and v not in seen:
                seen.add(v)
                queue.append(v)
    got = [r.url for r in Q["crawl_bfs"](spark, data).orderBy("position").collect()]
    assert got == order


class Sections(HTMLParser):
    """Depth-aware text of the first element of each kind, written apart from the library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.text, self.done = [], {}, set()

    def handle_starttag(self, tag, attrs):
        self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
            if tag in self.text:
                self.done.add(tag)

    def handle_data(self, data):
        if not {"script", "style"} & set(self.stack):
            for tag in {"header", "footer", "nav", "main"} & set(self.stack) - self.done:
                self.text[tag] = self.text.get(tag, "") + data


def test_parsed_sections(spark, data):
    got = {(r.page_id, r.section) for r in Q["structural_sections_parsed"](spark, data).collect()}
    want = set()
    for r in table(spark, data, "crawled_pages").filter("html_content is not null").collect():
        p = Sections()
        p.feed(r.html_content)
        want |= {(r.page_id, tag) for tag in p.text}
    assert got and got == want


def test_text_model(spark, data):
    got = Q["tfidf_train_predict"](spark, data).collect()
    docs = table(spark, data, "search_index")
    assert Counter(r.doc_idx for r in got) == Counter(r.doc_idx for r in docs.select("doc_idx").collect())
    assert all(r.prediction in (0, 1) and (r.confidence == 0 or 0.5 <= r.confidence <= 1) for r in got)
    rows = table(spark, data, "prototype_dataset").select("proto_id", F.concat_ws(" ", "title", "content").alias("text"), F.col("is_personal").alias("label")).filter("label is not null")
    model = learn.train(rows)
    hit = learn.predict(model, rows, "proto_id").join(rows, "proto_id").filter("prediction = label").count()
    assert hit >= 0.7 * rows.count()
    # idf is ln((1 + n) / (1 + docs)) + 1
    assert min(model.stages[5].getScalingVec().toArray()) >= 1.0
    assert learn.train(rows.limit(3)) is None and learn.train(rows.filter("label = 1")) is None


def test_sample_is_the_same_each_time(spark, data):
    first = {r.doc_idx for r in Q["quality_sample50"](spark, data).collect()}
    again = {r.doc_idx for r in Q["quality_sample50"](spark, data).collect()}
    assert len(first) == 50 and first == again


def test_cascade_stages(spark):
    rows = [(1, "https://a.example/", "x", "<p>x</p>"), (2, "https://a.example/", "x", "<p>x</p>"), (3, "https://a.example/", "", "<p>x</p>"), (4, None, None, None)]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "id int, url string, text string, html string, stage string, prediction int")
    tfidf = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.5), (3, 1, 0.9)], "id int, prediction int, confidence double")
    near = spark.createDataFrame([(2, 0.9, 0.1), (3, 0.9, 0.1)], "id int, personal double, corporate double")
    got = {r.id: (r.is_personal, r.stage_used) for r in classify.classify(pages, "id", "url", "text", "html", near, tfidf=tfidf).collect()}
    assert got[1] == (1, "tfidf") and got[2] == (1, "embedding") and got[3][1] == "weighted_vote" and got[4] == (0, "weighted_vote")
    assert classify.classify(pages.limit(0), "id", "url", None, None).count() == 0


def test_ingest_pipeline_on_odd_rows(spark):
    strong = "<p>" + "about me, my story, twitter.com github.com who i am /feed my experience .dev " * 2 + "</p>"
    cand = [("https://a.example/1", 1), ("https://a.example/1/", 2), ("https://A.example/known?x=1", 3), ("https://a.example/press/x", 4), ("https://a.example/none", 5), (None, 6), ("https://a.example/1", 7)]
    c = spark.createDataFrame(cand, "url string, pos int")
    pages = spark.createDataFrame([("https://a.example/1", 1, strong), ("https://a.example/none", 2, None), ("https://a.example/none", 3, "")], "url string, pos int, html_content string")
    known = spark.createDataFrame([("https://a.example/known",), (None,)], "url string")
    routed = ingest.pipeline(c, known, pages)
    got = {r.pos: r.route for r in routed.collect()}
    assert got == {1: got[1], 2: "duplicate", 3: "duplicate", 4: "prefiltered", 5: "no_content", 7: "duplicate"} and got[1] in ("add", "review", "reject")
    s = ingest.pipeline_summary(routed).first()
    assert (s.candidates, s.duplicates, s.prefiltered) == (6, 3, 1) and s.added + s.review + s.rejected == 2
    empty = ingest.pipeline(c.limit(0), known, pages)
    assert ingest.pipeline_summary(empty).first().success_rate == 0


def test_harvest_without_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html_content string, status_code int")
    links = crawl.harvest(none)
    assert links.count() == 0
    assert tuple(crawl.harvest_summary(crawl.indexed_hosts(none), links).first()) == (0, 0, 0, 0)


def test_page_classes_by_prototypes(spark):
    protos = spark.createDataFrame([(1, "My garden", "a", None, "my garden and my dog", 1), (2, "Buy now", "b", None, "buy our product now", 0), (3, None, None, None, None, None)], "proto_id int, title string, domain string, meta_description string, content string, is_personal int")
    pages = spark.createDataFrame([(1, "https://x.example/", "My garden", None, "my garden and my dog"), (2, None, None, None, None), (3, "https://y.example/", "Buy now", None, "buy our product now")], "doc_idx int, url string, title string, description string, content string")
    got = {r.doc_idx: r.is_personal for r in vectors.classify_pages(pages, protos, vectors.hashing_encoder(64), "doc_idx", 0.5).collect()}
    assert got == {1: 1, 2: None, 3: 0}
    assert vectors.embed_corpus(pages, "doc_idx", vectors.hashing_encoder(8), max_docs=2).count() == 2
    assert {len(r.embedding) for r in vectors.embed_corpus(pages, "doc_idx", vectors.hashing_encoder(8)).collect()} == {8}


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 50 + [9.0], [float(i * i % 37) for i in range(500)]])
def test_quantiles(spark, values):
    import numpy as np

    got = quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", {"a": 0.5, "b": 0.99, "c": 0.0}).first()
    assert np.allclose(tuple(got), np.quantile(values, [0.5, 0.99, 0.0]))


def test_a_broken_store_stays_as_it_is(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    made = files.load_or_create(spark, path, lambda: spark.range(3))
    assert made.count() == 3 and files.load_or_create(spark, path, lambda: spark.range(9)).count() == 3
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        files.load_or_create(spark, f"file://{broken}", lambda: spark.range(3)).count()
    assert (broken / "part-0.parquet").read_text() == "no parquet"
