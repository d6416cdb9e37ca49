"""Queries of the classifier, of links and of the ingest, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions import lexicon as L
from pagewright.functions import scoring as S
from pagewright.functions import urls as U
from pagewright.operators import classify as C
from pagewright.operators import crawl, ingest, learn
from pagewright.plans.runtime import spread, table
from pagewright.plans.scalar_queries import CANONICAL, WS, quoted

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _any(expr: str, needles) -> str:
    return f"len(list_filter({quoted(needles)}, lambda n: contains({expr}, n))) > 0"


def _domain_sql(expr: str) -> str:
    base = f"(CASE WHEN {_any(expr, L.DOMAIN_STRONG)} THEN 5 ELSE 0 END + CASE WHEN {_any(expr, L.DOMAIN_AGAINST)} THEN -5 ELSE 0 END)"
    return f"CASE WHEN {base} = 0 AND {_any(expr, L.DOMAIN_MEDIUM)} THEN 2 ELSE {base} END"


def _re(p: str) -> str:
    return "'" + L.re2(p).replace("'", "''") + "'"


def _count_sql(expr: str, g: L.Group) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({expr}, {_re(p)}))" for p in g.patterns) + ")"


def _content_sql(expr: str) -> str:
    return " + ".join(f"{_count_sql(expr, g)} * {g.weight}" for g in L.CONTENT)


#: Hosts that make every rule of the domain score fire.
HOSTS = ("me.github.io", "pineapple.com", "blog.wordpress.com", "dev.to.apple.com", "a.blogspot.com.forbes.com", "medium.com", "plain.example", "")
_HOSTS = ", ".join(f"({i}, '{h}')" for i, h in enumerate(HOSTS))


@query(f"""SELECT id, domain, CAST({_domain_sql('domain')} AS INT) AS score FROM (
    SELECT doc_idx AS id, {CANONICAL} AS domain FROM search_index UNION ALL SELECT * FROM (SELECT -1 - id AS id, domain FROM (VALUES {_HOSTS}) v(id, domain)))""")
def domain_score(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "search_index").select(F.col("doc_idx").alias("id"), U.canonical_domain(F.col("url")).alias("domain"))
    extra = spark.createDataFrame([(-1 - i, h) for i, h in enumerate(HOSTS)], "id long, domain string")
    return known.unionByName(extra).select("id", "domain", S.domain_score(F.col("domain")).alias("score"))


@query(f"""SELECT doc_idx, {', '.join(f"CAST({_count_sql('t', g)} AS INT) AS {g.name}" for g in L.CONTENT)}, CAST({_content_sql('t')} AS INT) AS content_score
    FROM (SELECT doc_idx, coalesce(content, '') AS t FROM search_index)""")
def content_score(spark: SparkSession, d: str) -> DataFrame:
    return C.content_scores(spread(table(spark, d, "search_index").select("doc_idx", "content")), "doc_idx", "content")


#: A lexicon whose patterns do occur in the test texts.
FIXTURE = (L.Group("articles", 1, (r"\bthe\b", r"\bthe\s+(inbox|drum)\b")), L.Group("notes", 2, (r"\bnotes\b", r"\bmy\s+(plan|rule)\b")))


@query(f"""SELECT doc_id, {', '.join(f"CAST({_count_sql('t', g)} AS INT) AS {g.name}" for g in FIXTURE)}, CAST({' + '.join(f"{_count_sql('t', g)} * {g.weight}" for g in FIXTURE)} AS INT) AS content_score
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def content_score_fixture(spark: SparkSession, d: str) -> DataFrame:
    return C.content_scores(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", FIXTURE)


_STRUCT_HTML = r"""(CASE WHEN h = '' THEN 0 ELSE 2 * CAST(regexp_matches(h, '(?is)<link[^>]*type\s*=\s*["'']application/rss\+xml["'']') AS INT)
    + CAST(regexp_matches(h, '(?is)<meta[^>]*property\s*=\s*["'']og:article:author["'']') AS INT)
    + CAST(regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/20[0-2][0-9]/') AS INT) END)"""
_PARTS = f"""(SELECT page_id, CAST({_domain_sql('dom')} AS INT) AS domain_score, CAST({_content_sql('t')} AS INT) AS content_score, CAST({_STRUCT_HTML} AS INT) AS structural_score
    FROM (SELECT page_id, url, coalesce(html_content, '') AS h, coalesce(html_content, '') AS t, coalesce({CANONICAL}, '') AS dom FROM crawled_pages))"""
_FILTERED = f"""(SELECT *, CASE WHEN domain_score >= 5 THEN true WHEN domain_score <= -5 THEN false ELSE total >= 3 END AS is_personal,
    CASE WHEN abs(domain_score) >= 5 THEN 0.9 WHEN abs(total) >= 3 THEN least(abs(total) / 10.0, 0.9) ELSE 0.3 END AS confidence,
    CAST(CASE WHEN abs(domain_score) >= 5 THEN domain_score ELSE total END AS DOUBLE) AS score,
    CASE WHEN abs(domain_score) >= 5 THEN 'domain' WHEN abs(total) >= 3 THEN 'content' ELSE 'uncertain' END AS stage
    FROM (SELECT *, domain_score + content_score + structural_score AS total FROM {_PARTS}))"""


@query(f"SELECT page_id, domain_score, content_score, structural_score, is_personal, CAST(confidence AS DOUBLE) AS confidence, score, stage FROM {_FILTERED}")
def filter_page(spark: SparkSession, d: str) -> DataFrame:
    return C.filtered(spread(table(spark, d, "crawled_pages").select("page_id", "url", "html_content")), "page_id", "url", "html_content", "html_content")


@query(f"SELECT is_personal, count(*) AS n FROM {_FILTERED} WHERE confidence >= 0.7 GROUP BY 1")
def weak_labels(spark: SparkSession, d: str) -> DataFrame:
    pages = C.filtered(spread(table(spark, d, "crawled_pages").select("page_id", "url", "html_content")), "page_id", "url", "html_content", "html_content")
    return C.weak_labels(pages).groupBy("is_personal").agg(F.count("*").alias("n"))


def _strip_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '(?is)<(?:script|style)\b.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '{WS}+', ' ', 'g'))"


def _lexicon_sql(expr: str) -> str:
    both = {**L.STRUCTURE_PERSONAL, **L.STRUCTURE_CORPORATE}
    return "(" + " + ".join(f"CASE WHEN regexp_matches({expr}, {_re(p)}) THEN {w} ELSE 0 END" for p, w in both.items()) + ")"


def _section_sql(tag: str) -> str:
    return rf"regexp_extract(h, '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>', 1)"


_LINKS = r"""list_transform(regexp_extract_all(h, '(?is)(<a\s[^>]*?href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>)', 1), lambda a: {'href': lower(regexp_extract(a, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1)),
    'text': lower(trim(regexp_replace(a, '(?s)<[^>]*>', '', 'g')))})"""
_LINK_SCORE = f"""coalesce(list_sum(list_transform({_LINKS}, lambda a: (CASE WHEN contains(a.href, 'twitter') OR contains(a.href, 'github') THEN 2 ELSE 0 END)
    + (CASE WHEN contains(a.text, 'about') OR contains(a.text, 'me') THEN 1 ELSE 0 END) - (CASE WHEN contains(a.href, 'contact') OR contains(a.href, 'privacy') THEN 1 ELSE 0 END)
    - (CASE WHEN contains(a.text, 'subscribe') OR contains(a.text, 'newsletter') THEN 2 ELSE 0 END))), 0)"""
_METAS = r"""list_transform(regexp_extract_all(h, '(?is)(<meta\b[^>]*>)', 1), lambda m: {'name': lower(regexp_extract(m, '(?is)\bname\s*=\s*["'']([^"'']*)["'']', 1)),
    'content': lower(regexp_extract(m, '(?is)\bcontent\s*=\s*["'']([^"'']*)["'']', 1))})"""
_META_SCORE = f"""coalesce(list_sum(list_transform({_METAS}, lambda m: (CASE WHEN contains(m.name, 'author') AND m.content <> '' THEN 2 ELSE 0 END)
    + (CASE WHEN contains(m.content, 'personal') OR contains(m.content, 'blog') THEN 2 ELSE 0 END) - (CASE WHEN contains(m.content, 'business') OR contains(m.content, 'corporate') THEN 2 ELSE 0 END)
    - (CASE WHEN contains(m.name, 'seo') OR contains(m.name, 'keywords') THEN 1 ELSE 0 END))), 0)"""
_SECTIONS = ("header", "nav", "main", "footer")
_STRUCTURE = f"""(SELECT *, text + header + nav + main + footer + links + metas AS total FROM (SELECT page_id, {_lexicon_sql('x')} AS text, {', '.join(f"{_lexicon_sql('x' + s)} AS {s}" for s in _SECTIONS)},
    CAST({_LINK_SCORE} AS INT) AS links, CAST({_META_SCORE} AS INT) AS metas
    FROM (SELECT page_id, h, {_strip_sql('h')} AS x, {', '.join(f"{_strip_sql(_section_sql(s))} AS x{s}" for s in _SECTIONS)} FROM (SELECT page_id, coalesce(html_content, '') AS h FROM crawled_pages))))"""


@query(f"SELECT * FROM {_STRUCTURE}")
def structural_sections(spark: SparkSession, d: str) -> DataFrame:
    return C.structural_parts(spread(table(spark, d, "crawled_pages").select("page_id", "url", "html_content")), "page_id", "html_content")


@query(f"SELECT page_id, CASE WHEN total > 5 THEN 1 WHEN total < -5 THEN 0 END AS prediction, least(abs(total) / 20.0, 1.0) AS confidence FROM {_STRUCTURE}")
def structural_decision(spark: SparkSession, d: str) -> DataFrame:
    parts = C.structural_parts(spread(table(spark, d, "crawled_pages").select("page_id", "url", "html_content")), "page_id", "html_content")
    return parts.select("page_id", S.structural_decision(F.col("total")).alias("r")).select("page_id", "r.*")


@query()
def structural_sections_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Sections cut by a real parser."""
    return C.section_scores_parsed(spread(table(spark, d, "crawled_pages").select("page_id", "url", "html_content")), "page_id", "html_content")


_IND = " UNION ALL ".join(
    f"SELECT page_id, '{kind}' AS type, '{p.replace(chr(39), chr(39) * 2)}' AS pattern, {w / 10} AS score, 'Found {kind} indicator: {p.replace(chr(39), chr(39) * 2)}' AS description FROM t WHERE regexp_matches(x, {_re(p)})"
    for kind, lex in (("personal", L.STRUCTURE_PERSONAL), ("corporate", L.STRUCTURE_CORPORATE))
    for p, w in lex.items()
)


@query(f"WITH t AS (SELECT page_id, {_strip_sql('html_content')} AS x FROM crawled_pages WHERE html_content IS NOT NULL) SELECT page_id, type, pattern, CAST(score AS DOUBLE) AS score, description FROM ({_IND})")
def structural_indicators(spark: SparkSession, d: str) -> DataFrame:
    t = spread(table(spark, d, "crawled_pages").select("page_id", "url", "html_content")).filter("html_content is not null").select("page_id", H.strip_tags(F.col("html_content")).alias("x")).withColumn("low", F.lower("x"))
    return t.select("page_id", F.explode(S.indicators(F.col("x"), F.col("low"))).alias("i")).select("page_id", "i.*")


#: Voters (prediction, confidence) per case: agreement, a tie, one voter, none, some.
VOTE_CASES = (
    (1, (1, 0.9), (1, 0.8), (1, 0.7), (1, 0.6)), (2, (1, 0.9), (None, None), (0, 0.9), (None, None)), (3, (None, None), (None, None), (None, None), (1, 0.4)),
    (4, (None, None), (None, None), (None, None), (None, None)), (5, (0, 0.3), (1, 0.6), (None, None), (1, 1.0)), (6, (1, 0.5), (0, 0.5), (0, 0.5), (1, 0.5)),
)
_NAMES = tuple(L.VOTES)
_CASES = "(VALUES " + ", ".join("(" + ", ".join(str(x) if x is not None else "NULL" for x in (c[0], *(v for pair in c[1:] for v in pair))) + ")" for c in VOTE_CASES) + ") v(id, " + ", ".join(f"{n}_p, {n}_c" for n in _NAMES) + ")"
_W = " + ".join(f"CASE WHEN {n}_p IS NULL THEN 0 ELSE {w} END" for n, w in L.VOTES.items())
_P = " + ".join(f"coalesce({n}_p, 0) * {w}" for n, w in L.VOTES.items())
_C = " + ".join(f"CASE WHEN {n}_p IS NULL THEN 0 ELSE {n}_c * {w} END" for n, w in L.VOTES.items())


@query(f"SELECT id, CASE WHEN w > 0 THEN CAST(p * 1.0 / w > 0.5 AS INT) END AS prediction, CASE WHEN w > 0 THEN round(c * 1.0 / w, 6) ELSE 0 END AS confidence FROM (SELECT id, {_W} AS w, {_P} AS p, {_C} AS c FROM {_CASES})")
def weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    schema = "id long, " + ", ".join(f"{n} struct<prediction:int,confidence:double>" for n in _NAMES)
    cases = spark.createDataFrame(list(VOTE_CASES), schema)
    r = cases.select("id", S.weighted_vote({n: (F.col(f"{n}.prediction"), F.col(f"{n}.confidence")) for n in _NAMES}).alias("r"))
    return r.select("id", "r.prediction", F.round("r.confidence", 6).alias("confidence"))


_S = f"(SELECT page_id, CASE WHEN total > 5 THEN 1 WHEN total < -5 THEN 0 END AS sp, least(abs(total) / 20.0, 1.0) AS sc FROM {_STRUCTURE})"


@query(f"""SELECT page_id, CASE WHEN sp IS NOT NULL AND sc >= 0.5 THEN sp ELSE CAST((30 * CAST(is_personal AS INT) + coalesce(15 * sp, 0)) * 1.0 / w > 0.5 AS INT) END AS is_personal,
    round(CASE WHEN sp IS NOT NULL AND sc >= 0.5 THEN sc ELSE (30 * confidence + CASE WHEN sp IS NULL THEN 0 ELSE 15 * sc END) / w END, 6) AS confidence,
    CASE WHEN sp IS NOT NULL AND sc >= 0.5 THEN 'structural' ELSE 'weighted_vote' END AS stage_used
    FROM (SELECT *, 30 + CASE WHEN sp IS NULL THEN 0 ELSE 15 END AS w FROM {_FILTERED} JOIN {_S} USING (page_id))""")
def cascade(spark: SparkSession, d: str) -> DataFrame:
    r = C.classify(spread(table(spark, d, "crawled_pages").select("page_id", "url", "html_content")), "page_id", "url", "html_content", "html_content")
    return r.select("page_id", "is_personal", F.round("confidence", 6).alias("confidence"), "stage_used")


_ROUTED = "SELECT doc_idx, CASE WHEN coalesce(is_personal, 0) = 1 AND confidence >= 0.85 THEN 'add' WHEN coalesce(is_personal, 0) = 1 AND confidence >= 0.75 THEN 'review' ELSE 'reject' END AS route FROM search_index"


@query(f"SELECT route, count(*) AS rows, count(*) * 1.0 / (SELECT count(*) FROM search_index) AS share FROM ({_ROUTED}) GROUP BY 1")
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "search_index").withColumn("route", C.route(F.col("is_personal"), F.col("confidence")))
    return ingest.summary(t)


def _key_sql(rel: str, cols: str) -> str:
    return f"(SELECT {cols}, lower(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', ''), '/+$', '')) AS k FROM {rel} WHERE url IS NOT NULL)"


@query(f"SELECT first(url ORDER BY page_id) AS url, min(page_id) AS page_id FROM {_key_sql('crawled_pages', 'url, page_id')} ANTI JOIN {_key_sql('search_index', 'doc_idx')} USING (k) GROUP BY k")
def ingest_new_urls(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawled_pages").select("url", "page_id")
    return ingest.new_urls(pages, table(spark, d, "search_index").select("url"), order="page_id")


@query("SELECT url, first(page_id ORDER BY fetched_at DESC NULLS LAST, page_id DESC) AS page_id, first(status_code ORDER BY fetched_at DESC NULLS LAST, page_id DESC) AS status_code FROM crawled_pages GROUP BY url")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "crawled_pages").select("url", "page_id", "status_code", "fetched_at")
    old, new = t.filter("page_id % 2 = 0"), t.filter("page_id % 2 = 1")
    return ingest.upsert(old, new, "url", ["fetched_at", "page_id"]).select("url", "page_id", "status_code")


_HREF = r'''regexp_extract_all(html_content, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)'''
_NET = "regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


@query(f"""SELECT DISTINCT page_id, link FROM (SELECT page_id, {_NET.format(x='url')} AS host, unnest({_HREF}) AS link FROM crawled_pages)
    WHERE starts_with(link, 'http') AND {_NET.format(x='link')} <> host AND NOT ({_any(_NET.format(x='link'), L.SKIPPED_HOSTS)})""")
def outgoing_links(spark: SparkSession, d: str) -> DataFrame:
    return crawl.outgoing_links(table(spark, d, "crawled_pages"))


@query(f"""SELECT DISTINCT page_id, regexp_replace(CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href ELSE href END, '#.*$', '') AS link
    FROM (SELECT page_id, url, unnest({_HREF}) AS href FROM crawled_pages) WHERE starts_with(href, '/') AND {_NET.format(x='url')} <> '' OR {_NET.format(x='href')} = {_NET.format(x='url')}""")
def same_site_links(spark: SparkSession, d: str) -> DataFrame:
    return crawl.same_site_links(table(spark, d, "crawled_pages"))


@query(f"""SELECT host, 'https://' || host || f AS feed FROM (SELECT DISTINCT {_NET.format(x='url')} AS host FROM crawled_pages), (SELECT unnest({quoted(L.FEED_PATHS)}) AS f) WHERE host <> ''
    UNION SELECT host, CASE WHEN starts_with(h, '/') THEN 'https://' || host || h ELSE h END FROM (SELECT host, regexp_extract(tag, '(?is)href\\s*=\\s*["'']([^"'']+)["'']', 1) AS h FROM (
      SELECT {_NET.format(x='url')} AS host, unnest(regexp_extract_all(html_content, '(?is)(<link\\b[^>]*type\\s*=\\s*["'']application/(?:rss|atom)\\+xml["''][^>]*>)', 1)) AS tag FROM crawled_pages)) WHERE h <> '' AND host <> ''""")
def feed_discovery(spark: SparkSession, d: str) -> DataFrame:
    return crawl.feeds(table(spark, d, "crawled_pages"))


@query()
def crawl_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first order from three seeds over the hosts that the pages link to, up to 100 hosts."""
    pages = table(spark, d, "crawled_pages")
    links = crawl.outgoing_links(pages).join(pages.select("page_id", U.canonical_domain(F.col("url")).alias("host")), "page_id")
    graph = links.select(F.col("host").alias("url"), U.canonical_domain(F.col("link")).alias("to")).distinct().groupBy("url").agg(F.collect_list("to").alias("links"))
    seeds = graph.select("url").orderBy("url").limit(3)
    return crawl.crawl_order(graph, seeds, 100)


@query(f"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g')), '[a-z0-9_]{{2,}}')) AS w FROM documents),
    n AS (SELECT count(*) AS n FROM t WHERE len(w) > 0) SELECT term, count(*) AS docs, round(ln((1 + any_value(n)) / (1.0 + count(*))) + 1, 6) AS idf FROM (SELECT unnest(w) AS term FROM t), n GROUP BY term HAVING count(*) >= 2""")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return learn.idf_weights(table(spark, d, "documents"), "doc_id", "text").select("term", "docs", F.round("idf", 6).alias("idf"))


@query()
def tfidf_train_predict(spark: SparkSession, d: str) -> DataFrame:
    """The prototypes train the model, the index is classified by it."""
    rows = table(spark, d, "prototype_dataset").select(F.concat_ws(" ", "title", "content").alias("text"), F.col("is_personal").alias("label")).filter("label is not null")
    model = learn.train(rows)
    docs = table(spark, d, "search_index").select("doc_idx", F.concat_ws(" ", "title", "content").alias("text"))
    return learn.predict(model, docs, "doc_idx")
