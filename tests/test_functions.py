from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions import lexicon as L
from pagewright.functions import scoring as S
from pagewright.functions import text as X
from pagewright.functions import urls as U


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("r")).first().r


URLS = {
    "HTTP://WWW.A.example:80/x/index.html": "http://a.example/x",
    "https://a.example:443/x/?b=2&a=1&utm_source=z&REF=q#top": "https://a.example/x?a=1&b=2",
    "https://a.example/myindex.html": "https://a.example/my",
    "https://a.example": "https://a.example/",
    "https://a.example/?a=&b=1": "https://a.example/?b=1",
    "https://a.example/?q=a+b~c*": "https://a.example/?q=a+b~c%2A",
    "//a.example/x//": "http://a.example/x",
    "https://a.example/p;v=1": "https://a.example/p",
    "": "",
    None: None,
}


def test_normalize(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    got = {r.u: r.n for r in df.select("u", U.normalize(F.col("u")).alias("n")).collect()}
    assert got == URLS


def test_normalize_is_idempotent(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string").select(U.normalize(F.col("u")).alias("n"))
    assert df.filter(~F.col("n").eqNullSafe(U.normalize(F.col("n")))).count() == 0


def test_ingest_key_and_domains(spark):
    u = "https://WWW.A.Example:8080/X/?q=1#f"
    assert one(spark, U.ingest_key(F.col("u")), u=u) == "https://www.a.example:8080/x"
    assert one(spark, U.canonical_domain(F.col("u")), u=u) == "a.example:8080"
    assert one(spark, U.extracted_domain(F.col("u")), u=u) == "WWW.A.Example:8080"
    assert one(spark, U.extracted_domain(F.lit(None).cast("string")), u="") == "unknown"


def test_prefilter_company_first(spark):
    r = one(spark, U.prefilter(F.col("u")), u="https://a.example/blog/press/x")
    assert (r.keep, r.reason) == (False, "Corporate pattern: /press/")
    assert one(spark, U.prefilter(F.col("u")), u="https://a.example/2024/x").reason == "Blog pattern: /202[0-9]/"
    assert one(spark, U.prefilter(F.col("u")), u="https://a.example/x").reason == "No clear pattern"


def test_absolute(spark):
    base = "https://a.example/b/c"
    for href, want in (("/x", "https://a.example/x"), ("d", "https://a.example/b/d"), ("../d", "https://a.example/d"), ("https://o.example/q", "https://o.example/q"), ("//o.example/q", "https://o.example/q")):
        assert one(spark, U.absolute(F.col("b"), F.col("h")), b=base, h=href) == want


def test_text(spark):
    assert one(spark, X.clean(F.col("t")), t=" a \n b ") == "a b"
    assert one(spark, X.preprocess(F.col("t")), t="A<b>B</b>") == "a b"
    assert one(spark, X.tokens(F.col("t")), t="The, a cat\tSat") == ["the,", "cat", "sat"]
    assert one(spark, X.tokens(F.lit(None).cast("string")), t="") == []
    r = X.representation(F.col("a"), F.col("b"), F.lit(None).cast("string"), F.col("c"))
    assert one(spark, r, a="T", b="", c="C" * 900) == "Title: T | Content: " + "C" * 800
    assert one(spark, X.repair(F.col("t")), t="aÃ¢â‚¬â€œb") == "a—œb"
    assert one(spark, X.repair(F.col("t"), fixed=True), t="aÃ¢â‚¬â€œb") == "a–b"
    df = X.repair_all(spark.createDataFrame([(1, "xÃ¢â‚¬Â¦", None)], "a int, b string, c string"))
    assert tuple(df.first()) == (1, "x…", None)


HTML = """<html><head><title> A
 B </title><meta name="author" content="Me"><meta name="keywords" content="seo business"></head><body>
<header>About me <nav>twitter.com</nav></header><main>my story</main>
<a href="/about">About</a><a class="x" href='https://github.com/me'>home</a><a href="/contact">subscribe now</a>
<script>var a = "</p>";</script></body></html>"""


def test_html(spark):
    assert one(spark, H.title(F.col("h")), h=HTML) == "A B"
    assert one(spark, H.title(F.col("h")), h="<title>Caf&#233; &amp;lt; &lt;b&gt; &#x2014; &hellip;</title>") == "Café &lt; <b> — …"
    assert one(spark, H.title(F.col("h")), h="<p>none</p>") == ""
    assert one(spark, H.hrefs(F.col("h")), h=HTML) == ["/about", "https://github.com/me", "/contact"]
    assert "var a" not in one(spark, H.strip_tags(F.col("h")), h=HTML)
    # about +1; github +2 and "me" inside home +1; contact -1 and subscribe -2
    assert one(spark, S.link_tenths(H.anchors(F.col("h"))), h=HTML) == 1
    # author +2; keywords -1 and business -2
    assert one(spark, S.meta_tenths(H.metas(F.col("h"))), h=HTML) == -1


def test_html_parts(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "<p>x"), (4, "")], "id int, h string")
    rows = df.lateralJoin(H.html_parts(F.col("h").outer())).select("id", "kind", "name", "value").collect()
    assert {r.id for r in rows} == {1}
    assert ("section", "header", "About me twitter.com") in {(r.kind, r.name, r.value) for r in rows}
    assert ("link", "https://github.com/me", "home") in {(r.kind, r.name, r.value) for r in rows}


def test_domain_score(spark):
    cases = {"x.github.io": 5, "pineapple.com": -5, "dev.to.apple.com": 0, "a.wordpress.com": 2, "dev.to.apple.com.wordpress.com": 2, "a.example": 0, "medium.com": 0}
    for host, want in cases.items():
        assert one(spark, S.domain_score(F.col("h")), h=host) == want
    assert one(spark, S.domain_score(F.lit(None).cast("string")), h="") == 0


def test_content_counts(spark):
    t = "In my opinion I think my blog leads. Lead magnet, lead. ROI, roi; opt-in customers customer"
    counts = {g.name: one(spark, c, t=t) for g, c in S.content_counts(F.col("t"), S.words(F.col("t")))}
    assert counts == {"personal_pronouns": 3, "personal_identity": 0, "marketing_terms": 0, "corporate_terms": 7}


def test_literals_are_in_every_match():
    import re

    for p in [p for g in L.CONTENT for p in g.patterns] + [*L.STRUCTURE_PERSONAL, *L.STRUCTURE_CORPORATE]:
        sample = re.sub(r"\(([^|)]*)[^)]*\)", r"\1", p.replace("\\b", ""))
        sample = re.sub(r"\\s[+*]", " ", sample).replace("\\", "")
        assert re.search(L.re2(p), sample), p
        assert L.literal(p) in sample.lower(), p
        if p.endswith("\\b") and p.startswith("\\b") and not L.single_word(p) and "*" not in p:
            assert set(L.markers(p)) & set(re.split("[^a-z0-9_]+", sample.lower())), p


def test_page_filter_borders(spark):
    for d, c, s, want in ((5, -99, 0, (True, 0.9, "domain")), (-5, 99, 0, (False, 0.9, "domain")), (0, 3, 0, (True, 0.3, "content")), (0, -3, 0, (False, 0.3, "content")), (2, 0, 0, (False, 0.3, "uncertain")), (0, 20, 0, (True, 0.9, "content"))):
        r = one(spark, S.page_filter(F.lit(d), F.lit(c), F.lit(s)), x=1)
        assert (r.is_personal, round(r.confidence, 6), r.stage) == want


def test_structural_borders(spark):
    for tenths, want in ((5, None), (6, 1), (-5, None), (-6, 0), (40, 1)):
        r = one(spark, S.structural_decision(F.lit(tenths)), x=1)
        assert r.prediction == want and r.confidence == min(abs(tenths) / 20, 1)
