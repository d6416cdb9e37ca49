"""Queries over URLs, text and HTML, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions import lexicon as L
from pagewright.functions import text as X
from pagewright.functions import urls as U
from pagewright.plans.runtime import table

QUERIES, ORACLE_SQL = {}, {}

#: White space as Java's \s has it, in the spelling of an RE2 engine.
WS = r"[\t\n\x0b\f\r ]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_NETLOC = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
CANONICAL = rf"regexp_replace(lower({_NETLOC}), '^www\.', '')"
_TRACK = f"list_contains({quoted(L.TRACKING_NAMES)}, lower(p.k)) OR len(list_filter({quoted(L.TRACKING_PREFIXES)}, lambda t: starts_with(lower(p.k), t))) > 0"
#: Normal form of ``url`` as an SQL expression over a relation with that column.
NORMAL_URL = rf"""CASE WHEN url = '' THEN url ELSE s || '://' ||
   CASE WHEN s = 'http' THEN regexp_replace(h, ':80$', '') WHEN s = 'https' THEN regexp_replace(h, ':443$', '') ELSE h END ||
   CASE WHEN p2 = '' OR regexp_matches(p2, '^/+$') THEN '/' ELSE regexp_replace(p2, '/+$', '') END ||
   CASE WHEN q = '' THEN '' ELSE '?' || q END END"""


def with_normal_url(relation: str, columns: str) -> str:
    """SELECT columns, the parts of url, and key (the normal url) from a relation."""
    return rf"""SELECT {columns}, {NORMAL_URL} AS key FROM (SELECT *,
      array_to_string(list_transform(list_sort(list_filter(list_transform(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1), '&'),
        lambda kv: {{'k': url_decode(regexp_extract(kv, '^([^=]*)', 1)), 'v': url_decode(regexp_extract(kv, '^[^=]*=(.*)$', 1))}}),
        lambda p: p.v <> '' AND NOT ({_TRACK}))), lambda p: url_encode(p.k) || '=' || url_encode(p.v)), '&') AS q,
      regexp_replace(CASE WHEN p1 = '' THEN '/' ELSE p1 END, 'index\.html$', '') AS p2 FROM (SELECT *,
      CASE WHEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) = '' THEN 'http' ELSE lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) END AS s,
      {CANONICAL} AS h,
      regexp_replace(regexp_extract(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '^//[^/?#]*', ''), '^([^?]*)', 1), ';[^/]*$', '') AS p1
      FROM {relation}))"""


@query(with_normal_url("search_index", "doc_idx"))
def url_normalize_api(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_index").select("doc_idx", U.normalize(F.col("url")).alias("key"))


@query(r"SELECT doc_idx, lower(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', ''), '/+$', '')) AS key FROM search_index")
def url_normalize_ingest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_index").select("doc_idx", U.ingest_key(F.col("url")).alias("key"))


@query(f"SELECT page_id, {CANONICAL} AS canonical, {_NETLOC} AS netloc, coalesce(regexp_replace({_NETLOC}, '^www\\.', ''), 'unknown') AS extracted FROM crawled_pages")
def url_domains(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "crawled_pages").select("page_id", U.canonical_domain(u).alias("canonical"), U.raw_netloc(u).alias("netloc"), U.extracted_domain(u).alias("extracted"))


def _first_sql(paths) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {'regexp_matches' if '[' in p else 'contains'}(lower(url), '{p}') THEN '{p}' END" for p in paths) + ")"


@query(f"""SELECT doc_idx, bad IS NULL AS keep, CASE WHEN bad IS NOT NULL THEN 'Corporate pattern: ' || bad WHEN good IS NOT NULL THEN 'Blog pattern: ' || good ELSE 'No clear pattern' END AS reason
    FROM (SELECT doc_idx, {_first_sql(L.PATHS_CORPORATE)} AS bad, {_first_sql(L.PATHS_BLOG)} AS good FROM search_index)""")
def url_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_index").select("doc_idx", U.prefilter(F.col("url")).alias("r")).select("doc_idx", "r.*")


def _unescape_sql(expr: str) -> str:
    for name, char in H.ENTITIES.items():
        expr = f"replace({expr}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    codes = f"list_distinct(regexp_extract_all({expr}, '&#([0-9]{{1,6}}|[xX][0-9a-fA-F]{{1,5}});', 1))"
    return f"replace(list_reduce(list_prepend({expr}, {codes}), lambda t, c: replace(t, '&#' || c || ';', chr(CAST(CASE WHEN lower(c[1]) = 'x' THEN '0x' || c[2:] ELSE c END AS INT)))), '&amp;', '&')"


_TITLE = "regexp_extract(html_content, '(?is)<title[^>]*>(.*?)</title>', 1)"


@query(rf"SELECT page_id, CASE WHEN t IS NOT NULL THEN trim(regexp_replace({_unescape_sql('t')}, '{WS}+', ' ', 'g')) END AS title FROM (SELECT page_id, {_TITLE} AS t FROM crawled_pages)")
def page_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawled_pages").select("page_id", H.title(F.col("html_content")).alias("title"))


@query(rf"SELECT doc_id, substring(trim(regexp_replace(text, '{WS}+', ' ', 'g')), 1, 1500) AS clean FROM documents")
def text_clean_1500(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.clean(F.col("text")).alias("clean"))


@query(rf"SELECT doc_idx, trim(regexp_replace(regexp_replace(lower(coalesce(content, '')), '<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g')) AS clean FROM search_index")
def text_preprocess(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_index").select("doc_idx", X.preprocess(F.col("content")).alias("clean"))


def _clean_sql(c: str) -> str:
    return f"substring(trim(regexp_replace({c}, '{WS}+', ' ', 'g')), 1, 1500)"


@query(f"""SELECT doc_idx, concat_ws(' | ', CASE WHEN {_clean_sql('title')} <> '' THEN 'Title: ' || {_clean_sql('title')} END, CASE WHEN domain <> '' THEN 'Domain: ' || domain END,
    CASE WHEN {_clean_sql('description')} <> '' THEN 'Description: ' || {_clean_sql('description')} END,
    CASE WHEN {_clean_sql('content')} <> '' THEN 'Content: ' || substring({_clean_sql('content')}, 1, 800) END) AS text FROM search_index""")
def text_representation(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "search_index")
    return t.select("doc_idx", X.representation(F.col("title"), F.col("domain"), F.col("description"), F.col("content")).alias("text"))


_TOKENS = f"list_filter(regexp_split_to_array(lower(coalesce(title, '')), '{WS}+'), lambda w: length(w) > 2)"


@query(f"SELECT doc_idx, len({_TOKENS}) AS n, array_to_string({_TOKENS}, ' ') AS tokens FROM search_index")
def tokens_gt2(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "search_index").select("doc_idx", X.tokens(F.col("title")).alias("t"))
    return t.select("doc_idx", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


def _repair_sql(c: str, pairs) -> str:
    for a, b in pairs:
        c = f"replace({c}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return c


@query(f"""SELECT doc_idx, {_repair_sql('title', L.MOJIBAKE)} AS title, {_repair_sql('content', L.MOJIBAKE)} AS content,
    {_repair_sql('title', sorted(L.MOJIBAKE, key=lambda kv: -len(kv[0])))} AS title_fixed FROM search_index""")
def mojibake_fix(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "search_index")
    return t.select("doc_idx", X.repair(F.col("title")).alias("title"), X.repair(F.col("content")).alias("content"), X.repair(F.col("title"), fixed=True).alias("title_fixed"))


@query("""SELECT doc_idx, length(content) AS n, coalesce(title, '') || ' ' || substring(coalesce(content, ''), 1, 500) AS embedding_text,
    substring(regexp_replace(coalesce(content, ''), '[<>]', '', 'g'), 1, 160) || '...' AS snippet, coalesce(author, '') AS author FROM search_index""")
def text_fields(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "search_index")
    return t.select(
        "doc_idx", F.length("content").cast("long").alias("n"), X.embedding_text(F.col("title"), F.col("content")).alias("embedding_text"), X.snippet(F.col("content")).alias("snippet"), X.default(F.col("author"), "").alias("author")
    )


@query(r"""SELECT page_id, len(h) AS n, array_to_string(h, ' ') AS hrefs FROM
    (SELECT page_id, regexp_extract_all(html_content, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS h FROM crawled_pages WHERE html_content IS NOT NULL)""")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "crawled_pages").filter("html_content is not null").select("page_id", H.hrefs(F.col("html_content")).alias("h"))
    return t.select("page_id", F.size("h").cast("long").alias("n"), F.array_join("h", " ").alias("hrefs"))


@query("""SELECT page_id, len(l) AS n, list_count(list_distinct(l)) AS n_distinct, array_to_string(l[1:5], ' ') AS first_five FROM
    (SELECT page_id, CASE WHEN links IS NOT NULL AND json_valid(links) THEN CAST(links AS VARCHAR[]) END AS l FROM (SELECT page_id, CAST(links AS JSON) AS links FROM crawled_pages)) WHERE l IS NOT NULL""")
def json_links(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "crawled_pages").select("page_id", F.from_json("links", "array<string>").alias("l")).filter("l is not null")
    return t.select("page_id", F.size("l").cast("long").alias("n"), F.size(F.array_distinct("l")).cast("long").alias("n_distinct"), F.array_join(F.slice("l", 1, 5), " ").alias("first_five"))
