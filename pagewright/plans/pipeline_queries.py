"""Queries that put stages together: the full cascade, page classification by prototypes, corpus vectors, ingest, harvest and index build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import lexicon as L
from pagewright.functions import scoring as S
from pagewright.operators import classify as C
from pagewright.operators import crawl, ingest, learn
from pagewright.operators import vectors as V
from pagewright.plans import classify_queries as Q
from pagewright.plans.runtime import materialize, spread, table
from pagewright.plans.scalar_queries import WS

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: A text model small enough to be written down: weights of words, and the intercept. It stands for a trained one where SQL has to follow.
WORDS = {"the": 0.02, "garden": 0.6, "blog": 0.5, "drum": 0.4, "cookies": -0.7, "copyright": -0.5, "privacy": -0.6}
INTERCEPT = -0.2

_CLEAN = rf"trim(regexp_replace(regexp_replace(lower(coalesce(html_content, '')), '<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g'))"
_Z = f"{INTERCEPT} + " + " + ".join(f"{w} * len(list_filter(w, lambda x: x = '{t}'))" for t, w in WORDS.items())
_TFIDF = f"""(SELECT page_id, CASE WHEN t = '' THEN 0 ELSE CAST(z > 0 AS INT) END AS tp, CASE WHEN t = '' THEN 0.0 ELSE 1 / (1 + exp(-abs(z))) END AS tc
  FROM (SELECT page_id, t, {_Z} AS z FROM (SELECT page_id, {_CLEAN} AS t, regexp_extract_all({_CLEAN}, '[a-z0-9_]+') AS w FROM crawled_pages)))"""
_EMBED = """(SELECT vec_id AS page_id, CASE WHEN greatest(personal, corporate) >= 0.7 THEN CAST(personal > corporate AS INT) END AS ep, greatest(personal, corporate) AS ec FROM (
  SELECT vec_id, coalesce(max(CASE WHEN label % 2 = 1 THEN s END), 0) AS personal, coalesce(max(CASE WHEN label % 2 = 0 THEN s END), 0) AS corporate FROM (
    SELECT v.vec_id, p.label, list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS s FROM embeddings v, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 100) p) GROUP BY 1))"""
_STAGES = f"""(SELECT page_id, CAST(is_personal AS INT) AS dp, confidence AS dc, CASE WHEN has THEN tp END AS tp, CASE WHEN has THEN tc END AS tc, CASE WHEN has THEN ep END AS ep, CASE WHEN has THEN ec END AS ec, sp, sc
  FROM {Q._FILTERED} JOIN {Q._S} USING (page_id) JOIN {_TFIDF} USING (page_id) LEFT JOIN {_EMBED} USING (page_id)
  JOIN (SELECT page_id, coalesce(html_content, '') <> '' AS has FROM crawled_pages) USING (page_id))"""
_V = {"d": 30, "t": 25, "e": 30, "s": 15}
_VW = " + ".join(f"CASE WHEN {n}p IS NULL THEN 0 ELSE {w} END" for n, w in _V.items())
_VP = " + ".join(f"coalesce({n}p, 0) * {w}" for n, w in _V.items())
_VC = " + ".join(f"CASE WHEN {n}p IS NULL THEN 0 ELSE {n}c * {w} END" for n, w in _V.items())


@query(f"""SELECT page_id, tp AS tfidf_prediction, round(tc, 6) AS tfidf_confidence, ep AS embedding_prediction, round(ec, 6) AS embedding_confidence,
    CASE WHEN tp IS NOT NULL AND tc >= 0.6 THEN tp WHEN ep IS NOT NULL AND ec >= 0.7 THEN ep WHEN sp IS NOT NULL AND sc >= 0.5 THEN sp ELSE CAST(p * 1.0 / w > 0.5 AS INT) END AS is_personal,
    round(CASE WHEN tp IS NOT NULL AND tc >= 0.6 THEN tc WHEN ep IS NOT NULL AND ec >= 0.7 THEN ec WHEN sp IS NOT NULL AND sc >= 0.5 THEN sc ELSE c / w END, 6) AS confidence,
    CASE WHEN tp IS NOT NULL AND tc >= 0.6 THEN 'tfidf' WHEN ep IS NOT NULL AND ec >= 0.7 THEN 'embedding' WHEN sp IS NOT NULL AND sc >= 0.5 THEN 'structural' ELSE 'weighted_vote' END AS stage_used
    FROM (SELECT *, {_VW} AS w, {_VP} AS p, {_VC} AS c FROM {_STAGES})""")
def cascade_full(spark: SparkSession, d: str) -> DataFrame:
    """All four stages of the cascade: rules, a text model, prototypes (the page's vector is the one of its number), and structure."""
    pages = spread(table(spark, d, "crawled_pages").select("page_id", "url", "html_content"))
    tfidf = learn.predict_words(pages, "page_id", "html_content", WORDS, INTERCEPT)
    vectors = table(spark, d, "embeddings")
    protos = vectors.orderBy("vec_id").limit(100).select("vec_id", "embedding", (F.col("label") % 2).alias("label"))
    near = V.class_maxima(vectors, protos).withColumnRenamed("vec_id", "page_id")
    r = C.classify(pages, "page_id", "url", "html_content", "html_content", near, tfidf=tfidf)
    has = pages.select("page_id", (F.coalesce("html_content", F.lit("")) != "").alias("has"))
    e = near.select("page_id", V.prototype_decision(F.col("personal"), F.col("corporate")).alias("e"))
    out = r.join(tfidf.select("page_id", F.struct("prediction", "confidence").alias("t")), "page_id").join(has, "page_id").join(e, "page_id", "left")
    return out.select(
        "page_id", F.when(F.col("has"), F.col("t.prediction")).alias("tfidf_prediction"), F.when(F.col("has"), F.round("t.confidence", 6)).alias("tfidf_confidence"),
        F.when(F.col("has"), F.col("e.prediction")).alias("embedding_prediction"), F.when(F.col("has"), F.round("e.confidence", 6)).alias("embedding_confidence"),
        "is_personal", F.round("confidence", 6).alias("confidence"), "stage_used",
    )


DIM = 256


def _vector_sql(rel: str, key: str, text: str) -> str:
    """(key, b, x): the coordinates of the word vector of ``text`` that are not 0."""
    words = f"SELECT {key}, unnest(list_filter(regexp_split_to_array(lower({text}), '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda w: w <> '')) AS w FROM {rel}"
    n = f"SELECT {key}, CAST('0x' || substr(md5(w), 1, 4) AS INT) % {DIM} AS b, count(*) AS n FROM ({words}) GROUP BY ALL"
    return f"(SELECT {key}, b, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM ({n}))"


def _repr_sql(domain: str, description: str) -> str:
    def clean(c: str) -> str:
        return f"substring(trim(regexp_replace({c}, '{WS}+', ' ', 'g')), 1, 1500)"

    def part(label: str, c: str) -> str:
        return f"CASE WHEN {c} <> '' THEN '{label}: ' || {c} END"

    cut = f"substring({clean('content')}, 1, 800)"
    return f"concat_ws(' | ', {part('Title', clean('title'))}, {part('Domain', domain)}, {part('Description', clean(description))}, {part('Content', cut)})"


_EXTRACTED = r"coalesce(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^www\.', ''), 'unknown')"
_PAGE_TEXT = f"(SELECT doc_idx, {_EXTRACTED} AS dom, {_repr_sql(_EXTRACTED, 'description')} AS t FROM search_index)"
_PROTO_TEXT = f"(SELECT proto_id, is_personal, {_repr_sql('domain', 'meta_description')} AS t FROM prototype_dataset WHERE is_personal IS NOT NULL)"


@query(f"""WITH a AS {_vector_sql(_PAGE_TEXT, 'doc_idx', 't')}, p AS (SELECT * FROM {_vector_sql(_PROTO_TEXT, 'proto_id', 't')} JOIN (SELECT proto_id, is_personal FROM prototype_dataset) USING (proto_id)),
    s AS (SELECT doc_idx, proto_id, any_value(is_personal) AS y, sum(a.x * p.x) AS s FROM a JOIN p USING (b) GROUP BY ALL),
    m AS (SELECT doc_idx, coalesce(max(CASE WHEN y = 1 THEN s END), 0) AS personal, coalesce(max(CASE WHEN y = 0 THEN s END), 0) AS corporate FROM s GROUP BY 1)
    SELECT doc_idx, dom AS domain, CASE WHEN greatest(personal, corporate) >= 0.5 THEN CAST(personal > corporate AS INT) END AS is_personal, round(greatest(personal, corporate), 6) AS confidence FROM m JOIN {_PAGE_TEXT} USING (doc_idx)""")
def classify_page(spark: SparkSession, d: str) -> DataFrame:
    """Text representation, word vectors and nearest prototypes of every page."""
    pages = spread(table(spark, d, "search_index").select("doc_idx", "url", "title", "description", "content"))
    r = V.classify_pages(pages, table(spark, d, "prototype_dataset"), V.hashing_encoder(DIM), "doc_idx", 0.5)
    return r.select("doc_idx", "domain", "is_personal", F.round("confidence", 6).alias("confidence"))


def _corpus_sql(rel: str) -> str:
    v = _vector_sql(f"(SELECT doc_idx, coalesce(title, '') || ' ' || substring(coalesce(content, ''), 1, 500) AS t FROM {rel})", "doc_idx", "t")
    return f"SELECT doc_idx, count(x) AS filled, round(coalesce(sum(x * (b + 1)), 0), 6) AS moment FROM {rel} LEFT JOIN {v} USING (doc_idx) GROUP BY doc_idx"


def _described(vectors: DataFrame) -> DataFrame:
    moment = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return vectors.select("doc_idx", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("filled"), F.round(moment, 6).alias("moment"))


@query(_corpus_sql("search_index"))
def corpus_embedding(spark: SparkSession, d: str) -> DataFrame:
    """The vector of every document, as the number of its coordinates that are not 0 and their first moment."""
    return _described(V.embed_corpus(spread(table(spark, d, "search_index").select("doc_idx", "title", "content")), "doc_idx", V.hashing_encoder(DIM), kind="array<double>"))


@query(_corpus_sql("(SELECT * FROM search_index ORDER BY doc_idx LIMIT 500)"))
def corpus_embedding_capped(spark: SparkSession, d: str) -> DataFrame:
    """The same with the operator's cap on documents."""
    return _described(V.embed_corpus(table(spark, d, "search_index"), "doc_idx", V.hashing_encoder(DIM), max_docs=500, kind="array<double>"))


def _pre_sql(expr: str) -> str:
    bad = " ".join(f"WHEN contains(lower({expr}), '{p}') THEN '{p}'" for p in L.PATHS_CORPORATE)
    good = " ".join(f"WHEN regexp_matches(lower({expr}), '{p}') THEN '{p}'" for p in L.PATHS_BLOG)
    return f"CASE {bad} END AS bad, CASE {good} END AS good"


_KEY = "lower(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', ''), '/+$', ''))"
#: The rule stage and the structure without a text, as the ingest calls the cascade.
_RULES_NO_TEXT = Q._FILTERED.replace("coalesce(html_content, '') AS t,", "'' AS t,")
_INGEST = f"""(WITH c AS (SELECT page_id, url, {_KEY} AS k FROM crawled_pages WHERE url IS NOT NULL),
  f AS (SELECT k, min(page_id) AS f FROM c GROUP BY 1), x AS (SELECT DISTINCT {_KEY} AS k, true AS known FROM search_index WHERE url IS NOT NULL),
  s AS (SELECT c.page_id, c.url, coalesce(known, false) OR c.page_id > f AS dup, {_pre_sql('c.url')} FROM c JOIN f USING (k) LEFT JOIN x USING (k)),
  h AS (SELECT url, min(page_id) AS src FROM crawled_pages WHERE length(html_content) > 0 GROUP BY 1),
  j AS (SELECT page_id AS src, CASE WHEN sp IS NOT NULL AND sc >= 0.5 THEN sp ELSE CAST((30 * CAST(is_personal AS INT) + coalesce(15 * sp, 0)) * 1.0 / w > 0.5 AS INT) END AS yes,
      CASE WHEN sp IS NOT NULL AND sc >= 0.5 THEN sc ELSE (30 * confidence + CASE WHEN sp IS NULL THEN 0 ELSE 15 * sc END) / w END AS conf
      FROM (SELECT *, 30 + CASE WHEN sp IS NULL THEN 0 ELSE 15 END AS w FROM {_RULES_NO_TEXT} JOIN {Q._S} USING (page_id)))
  SELECT s.url, s.page_id, CASE WHEN dup THEN 'duplicate' WHEN bad IS NOT NULL THEN 'prefiltered' WHEN h.src IS NULL THEN 'no_content' WHEN yes = 1 AND conf >= 0.85 THEN 'add' WHEN yes = 1 AND conf >= 0.75 THEN 'review' ELSE 'reject' END AS route,
    CASE WHEN dup THEN 'Already indexed' WHEN bad IS NOT NULL THEN 'Corporate pattern: ' || bad WHEN good IS NOT NULL THEN 'Blog pattern: ' || good ELSE 'No clear pattern' END AS reason,
    CASE WHEN NOT dup AND bad IS NULL THEN round(conf, 6) END AS confidence FROM s LEFT JOIN h ON h.url = s.url LEFT JOIN j ON j.src = h.src)"""


def _routed(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawled_pages")
    candidates = pages.select("url", "page_id")
    return ingest.pipeline(candidates, table(spark, d, "search_index"), pages.select("url", "page_id", "html_content"), "page_id")


@query(f"SELECT * FROM {_INGEST}")
def ingest_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Every fetched page as a candidate for the index: known, filtered by path, without content, or classified and routed."""
    return _routed(spark, d).withColumn("confidence", F.round("confidence", 6))


@query(f"""SELECT count(*) AS candidates, count(*) FILTER (WHERE route = 'prefiltered') AS prefiltered, count(*) FILTER (WHERE route = 'duplicate') AS duplicates, count(*) FILTER (WHERE route = 'add') AS added,
    count(*) FILTER (WHERE route = 'review') AS review, count(*) FILTER (WHERE route IN ('reject', 'no_content')) AS rejected,
    CASE WHEN count(*) FILTER (WHERE route NOT IN ('duplicate', 'prefiltered')) > 0 THEN 100.0 * count(*) FILTER (WHERE route = 'add') / count(*) FILTER (WHERE route NOT IN ('duplicate', 'prefiltered')) ELSE 0.0 END AS success_rate FROM {_INGEST}""")
def ingest_pipeline_summary(spark: SparkSession, d: str) -> DataFrame:
    return ingest.pipeline_summary(_routed(spark, d))


@query("SELECT doc_idx, CAST(length(content) AS INT) AS content_length FROM search_index WHERE coalesce(is_personal, 0) = 1 AND content <> ''")
def index_build(spark: SparkSession, d: str) -> DataFrame:
    """The rows that an index of personal pages takes."""
    return ingest.build_index(table(spark, d, "search_index")).select("doc_idx", "content_length")


#: Pages that hold every kind of link the harvest looks for: (page_id, url, status_code, html_content).
PLANTED = (
    (-1, "https://a.planted.example/", 200, '<a href="https://b.planted.example/x">My favorites</a> <a href="/about/">About me</a> <a href="/reading">Reading list</a> <a href="https://github.com/a">Friends</a> <a href="/own">links</a> <a href="mailto:x">friends</a>'),
    (-2, "https://a.planted.example/about/", 200, '<a href="https://c.planted.example/">My old blog</a> <a href="https://d.planted.example/">nothing</a> <a href="https://twitter.com/a">site</a>'),
    (-3, "https://a.planted.example/reading", 200, '<a href="https://e.planted.example/">one</a> <a href="https://e.planted.example/">one again</a> <a href="/local">two</a>'),
    (-4, "https://b.planted.example/", 404, '<a href="https://c.planted.example/">friends</a>'),
    (-5, "https://b.planted.example/2", 200, '<a href="https://c.planted.example/">blogs i read</a>'),
    (-6, "https://b.planted.example/3", 200, None),
)


def _lit(v) -> str:  # noqa: ANN001
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


_PAGES = "(SELECT page_id, url, status_code, html_content FROM crawled_pages UNION ALL SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in PLANTED) + "))"
_NET = Q._NET


def _planted(spark: SparkSession, d: str) -> DataFrame:
    extra = spark.createDataFrame(list(PLANTED), "page_id long, url string, status_code int, html_content string")
    return table(spark, d, "crawled_pages").select("page_id", "url", F.col("status_code").cast("int").alias("status_code"), "html_content").unionByName(extra)


_ROOT = "regexp_extract({x}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_A = rf"""(SELECT page_id, url, status_code, regexp_extract(a, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) AS href, lower(trim(regexp_replace(a, '(?s)<[^>]*>', '', 'g'))) AS text
  FROM (SELECT page_id, url, status_code, unnest(regexp_extract_all(html_content, '(?is)(<a\s[^>]*?href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>)', 1)) AS a FROM {_PAGES}))"""
_ABS = f"CASE WHEN starts_with(href, '/') THEN {_ROOT.format(x='url')} || href ELSE href END"


def _other(rel: str, cols: str) -> str:
    return f"SELECT DISTINCT {cols}, link FROM ({rel}) WHERE NOT ({Q._any(_NET.format(x='link'), L.SKIPPED_HOSTS)}) AND {_NET.format(x='link')} <> host"


def _named(where: str = "true") -> str:
    return _other(f"SELECT page_id, {_NET.format(x='url')} AS host, {_ABS} AS link FROM {_A} WHERE {where} AND ({Q._any('text', L.BLOGROLL_TEXTS)}) AND (starts_with(href, 'http') OR starts_with(href, '/'))", "page_id")


def _subpages(mark: str, texts: tuple[str, ...], where: str = "true") -> str:
    target = f"SELECT DISTINCT page_id, regexp_replace({_ABS}, '#.*$', '') AS base FROM {_A} WHERE {where} AND (regexp_matches(lower(href), '{mark}') OR regexp_matches(text, '{mark}'))"
    wanted = f"SELECT url AS base, href AS link FROM {_A} WHERE {where} AND starts_with(href, 'http')" + (f" AND ({Q._any('text', texts)})" if texts else "")
    return f"SELECT DISTINCT page_id, link FROM ({target}) JOIN ({wanted}) USING (base)"


@query(_named())
def blogroll_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of anchors that name a blogroll."""
    return crawl.blogroll_links(_planted(spark, d))


@query(_subpages("about", crawl.ABOUT_TEXTS))
def about_page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links on the about pages that pages lead to."""
    return crawl.links_of_subpages(_planted(spark, d), "about", crawl.ABOUT_TEXTS)


@query(_subpages("favorites?|reading", ()))
def favourites_links(spark: SparkSession, d: str) -> DataFrame:
    """Links on the pages of favourites that pages lead to."""
    return crawl.links_of_subpages(_planted(spark, d), "favorites?|reading")


_OK = "status_code = 200"
_HARVEST = _other(
    f"""SELECT h.host, l.link FROM ({_named(_OK)} UNION ALL {_subpages('about', crawl.ABOUT_TEXTS, _OK)} UNION ALL {_subpages('favorites?|reading', (), _OK)}) l
    JOIN (SELECT page_id, {_NET.format(x='url')} AS host FROM {_PAGES} WHERE {_OK}) h USING (page_id) WHERE h.host <> ''""",
    "host",
)


@query(_HARVEST)
def harvest_links(spark: SparkSession, d: str) -> DataFrame:
    """What the pages of each host lead to."""
    return crawl.harvest(_planted(spark, d))


@query(f"""SELECT (SELECT count(DISTINCT {_NET.format(x='url')}) FROM {_PAGES} WHERE {_NET.format(x='url')} <> '') AS domains_processed, (SELECT count(DISTINCT host) FROM ({_HARVEST})) AS domains_with_blogrolls,
    (SELECT count(*) FROM ({_HARVEST})) AS total_blogroll_links, (SELECT count(DISTINCT link) FROM ({_HARVEST})) AS unique_blogroll_links""")
def harvest_summary(spark: SparkSession, d: str) -> DataFrame:
    pages = _planted(spark, d)
    return crawl.harvest_summary(crawl.indexed_hosts(pages), materialize(crawl.harvest(pages), "harvest"))


@query(f"SELECT DISTINCT {_NET.format(x='url')} AS host FROM search_index WHERE {_NET.format(x='url')} <> ''")
def indexed_hosts(spark: SparkSession, d: str) -> DataFrame:
    return crawl.indexed_hosts(table(spark, d, "search_index"))


#: What was fetched from feed addresses: an RSS feed, an Atom feed, a missing one.
FEEDS = (
    ("https://mossfenjournal.example/feed.xml", "<rss><item><link>https://mossfenjournal.example/1</link></item><item><link><![CDATA[https://mossfenjournal.example/2]]></link></item><item><link>https://mossfenjournal.example/1</link></item></rss>", 200),
    ("https://mossfenjournal.example/atom", '<feed><entry><link href="https://mossfenjournal.example/3"/></entry><entry><title>no link</title></entry></feed>', 200),
    ("https://mossfenjournal.example/rss", "<rss><item><link>https://mossfenjournal.example/9</link></item></rss>", 404),
    ("https://nowhere.example/feed", "<rss><item><link>https://nowhere.example/1</link></item></rss>", 200),
)


@query("""SELECT * FROM (VALUES ('mossfenjournal.example', 'https://mossfenjournal.example/1'), ('mossfenjournal.example', 'https://mossfenjournal.example/2'), ('mossfenjournal.example', 'https://mossfenjournal.example/3')) v(host, link)
    WHERE (SELECT count(*) FROM crawled_pages WHERE regexp_matches(url, '^https?://mossfenjournal\\.example(/|$)')) > 0""")
def enhanced_crawl(spark: SparkSession, d: str) -> DataFrame:
    """The links of all feeds of each host, from feeds that were fetched."""
    docs = spark.createDataFrame(list(FEEDS), "url string, xml string, status_code int")
    return crawl.enhanced_crawl(table(spark, d, "crawled_pages"), docs)


@query(rf"""SELECT host, CASE WHEN starts_with(h, '/') THEN 'https://' || host || h ELSE h END AS feed FROM (SELECT host, regexp_extract(tag, '(?is)href\s*=\s*["'']([^"'']+)["'']', 1) AS h FROM (
      SELECT {_NET.format(x='url')} AS host, unnest(regexp_extract_all(html_content, '(?is)(<link\b[^>]*type\s*=\s*["'']application/(?:rss|atom)\+xml["''][^>]*>)', 1)) AS tag FROM crawled_pages)) WHERE h <> '' AND host <> ''
    UNION SELECT 'mossfenjournal.example', 'https://mossfenjournal.example/atom' WHERE (SELECT count(*) FROM crawled_pages WHERE {_NET.format(x='url')} = 'mossfenjournal.example') > 0""")
def feeds_that_answer(spark: SparkSession, d: str) -> DataFrame:
    """Declared feeds, and of the usual places those that answered."""
    answers = spark.createDataFrame([(u, s) for u, _, s in FEEDS], "url string, status_code int")
    return crawl.feeds(table(spark, d, "crawled_pages"), answers=answers)


_REASONS = " UNION ALL ".join(
    f"SELECT doc_idx, '{g.name}' AS category, '{p}' AS pattern, len(regexp_extract_all(content, {Q._re(p)})) AS matches, '{'Positive' if g.weight > 0 else 'Negative'}' AS sign FROM search_index"
    for g in L.CONTENT
    for p in g.patterns
)


@query(f"SELECT doc_idx, category, pattern, CAST(matches AS INT) AS matches, sign || ' (' || category || '): ' || matches || ' matches' AS reason FROM ({_REASONS}) WHERE matches > 0")
def content_reasons(spark: SparkSession, d: str) -> DataFrame:
    """One row per content pattern that a document matches."""
    t = spread(table(spark, d, "search_index").select("doc_idx", "content"))
    return t.select("doc_idx", F.explode(S.content_reasons(F.col("content"))).alias("r")).select("doc_idx", "r.*")


@query("SELECT event_id, strftime(searched_at, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(searched_at, '%Y-%m-%d') AS day FROM search_log")
def log_dates(spark: SparkSession, d: str) -> DataFrame:
    """Times as reports write them."""
    t = table(spark, d, "search_log")
    return t.select("event_id", F.date_format("searched_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("searched_at", "yyyy-MM-dd").alias("day"))
