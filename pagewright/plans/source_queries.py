"""Round trips through sources and sinks: tables written in the form a source reads, read back, and held against the tables by SQL."""

from __future__ import annotations

import json
import os
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import lexicon as L
from pagewright.operators import api
from pagewright.plans.runtime import scratch_path, table
from pagewright.plans.search_queries import _hits
from pagewright.sources import files, web
from pagewright.sources.sqlite import SqliteSource, write_upsert

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _as_file(df: DataFrame, path: str) -> str:
    """One text file of one column, for tables of fixed size."""
    df.coalesce(1).write.mode("overwrite").text(path)
    return path


def _prototypes_json(spark: SparkSession, d: str) -> str:
    """The fixed table of prototypes as a JSON array."""
    rows = table(spark, d, "prototype_dataset").drop("proto_id")
    array = rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("*"))), ","), F.lit("]")).alias("value"))
    return _as_file(array, scratch_path(spark, "prototypes"))


@query("SELECT url, title, domain, meta_description, content, author, CAST(is_personal AS INT) AS is_personal, coalesce(is_personal = 1, false) AS personal FROM prototype_dataset")
def json_prototypes(spark: SparkSession, d: str) -> DataFrame:
    """Labelled prototypes from a JSON array, split by their label."""
    yes, no = files.read_prototypes(spark, _prototypes_json(spark, d))
    return yes.withColumn("personal", F.lit(True)).unionByName(no.withColumn("personal", F.lit(False)))


@query("SELECT url, title, content, CAST(is_personal AS INT) AS is_personal, CAST(NULL AS DOUBLE) AS confidence FROM prototype_dataset")
def json_documents(spark: SparkSession, d: str) -> DataFrame:
    """Search documents from a JSON array in which fields are missing."""
    return files.read_documents(spark, _prototypes_json(spark, d)).select("url", "title", "content", "is_personal", "confidence")


_TAXONOMY = [("content", "positive" if g.weight > 0 else "negative", g.name, i, p, g.weight) for g in L.CONTENT for i, p in enumerate(g.patterns)] + [
    ("domain", "positive" if w > 0 else "negative", name, i, p, w)
    for name, ps, w in (("strong", L.DOMAIN_STRONG, 5), ("medium", L.DOMAIN_MEDIUM, 2), ("against", L.DOMAIN_AGAINST, -5))
    for i, p in enumerate(ps)
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{o}', '{c}', {i}, '{p}', {w})" for s, o, c, i, p, w in _TAXONOMY) + ") v(scope, polarity, category, ord, pattern, weight)")
def taxonomy_scan(spark: SparkSession, d: str) -> DataFrame:
    """The lexicon as a taxonomy file, read back as one row per pattern."""

    def part(scope: str, polarity: str | None = None) -> dict:
        out: dict = {}
        for s, o, c, _, p, w in _TAXONOMY:
            if s == scope and polarity in (None, o):
                out.setdefault(c, {"patterns": [], "weight": w})["patterns"].append(p)
        return out

    doc = {"domain_patterns": part("domain"), "content_indicators": {"positive_regex": part("content", "positive"), "negative_regex": part("content", "negative")}}
    return files.read_taxonomy(spark, _as_file(spark.createDataFrame([(json.dumps(doc),)], "value string"), scratch_path(spark, "taxonomy")))


@query("SELECT url FROM prototype_dataset WHERE url IS NOT NULL ORDER BY proto_id LIMIT 3")
def seeds_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first three addresses of a JSON list."""
    urls = table(spark, d, "prototype_dataset").filter("url is not null").agg(F.transform(F.array_sort(F.collect_list(F.struct("proto_id", "url"))), lambda x: x["url"]).alias("u"))
    return files.read_seeds(spark, _as_file(urls.select(F.to_json("u").alias("value")), scratch_path(spark, "seeds")))


@query("SELECT doc_idx, url, title, content_length FROM search_index UNION ALL SELECT doc_idx, url, title, content_length FROM search_index WHERE batch_no = 6")
def index_append(spark: SparkSession, d: str) -> DataFrame:
    """The index as JSON lines, a batch appended to it, and read back."""
    rows = table(spark, d, "search_index").select("doc_idx", "url", "title", "content_length", "batch_no")
    path = scratch_path(spark, "index")
    files.write_index(rows.drop("batch_no"), path, fmt="json")
    files.write_index(rows.filter("batch_no = 6").drop("batch_no"), path, mode="append", fmt="json")
    return spark.read.schema("doc_idx long, url string, title string, content_length int").json(path)


@query("SELECT count(*) AS docs, count(DISTINCT lower(domain)) AS domains FROM search_index")
def report_sink(spark: SparkSession, d: str) -> DataFrame:
    """A report as JSON, read back."""
    path = scratch_path(spark, "report")
    files.write_report(table(spark, d, "search_index").agg(F.count("*").alias("docs"), F.count_distinct(F.lower("domain")).alias("domains")), path)
    return spark.read.schema("docs long, domains long").json(path)


@query("SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """The vectors in a store that is made on first use and found the second time."""
    path = scratch_path(spark, "vectors")
    files.load_or_create(spark, path, lambda: table(spark, d, "embeddings").select("vec_id", "embedding"))
    again = files.load_or_create(spark, path, lambda: spark.range(0).select(F.col("id").alias("vec_id")))
    return again.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query("SELECT vec_id, CAST(label % 2 AS INT) AS label, CAST(0.7 AS DOUBLE) AS threshold FROM embeddings ORDER BY vec_id LIMIT 100")
def prototype_store(spark: SparkSession, d: str) -> DataFrame:
    """Prototype vectors and their parameters, stored and read back."""
    path = scratch_path(spark, "store")
    protos = table(spark, d, "embeddings").orderBy("vec_id").limit(100).select("vec_id", (F.col("label") % 2).cast("int").alias("label"), "embedding")
    files.write_prototype_store(protos, {"threshold": 0.7}, path)
    vectors, params = files.read_prototype_store(spark, path)
    return vectors.select("vec_id", "label", F.lit(params["threshold"]).alias("threshold"))


@query("SELECT proto_id, title, content FROM prototype_dataset WHERE content <> '' AND proto_id % 2 = 0 UNION ALL SELECT proto_id, 'changed', content FROM prototype_dataset WHERE content <> '' AND proto_id % 2 = 1")
def sqlite_scan(spark: SparkSession, d: str) -> DataFrame:
    """The fixed table of prototypes in SQLite, half of it written twice (the last write wins), scanned in parts; the database filters and prunes."""
    path = scratch_path(spark, "sqlite")
    if urlsplit(path).scheme not in ("", "file"):
        raise ValueError("SQLite needs a shared folder that is mounted as files")
    os.makedirs(urlsplit(path).path)
    local = urlsplit(path).path + "/rows.db"
    rows = [r.asDict() for r in table(spark, d, "prototype_dataset").select("proto_id", "title", "content", "author").collect()]  # 240 rows
    write_upsert(iter(rows), local, "prototypes", "proto_id", list(rows[0]) if rows else ["proto_id", "title", "content", "author"])
    write_upsert(({**r, "title": "changed"} for r in rows if r["proto_id"] % 2), local, "prototypes", "proto_id", list(rows[0]) if rows else [])
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").schema("proto_id long, title string, content string")
    return reader.option("path", local).option("table", "prototypes").option("partitions", "4").option("where", "content <> ''").load()


_FEED = "https://feeds.example/"


@query(f"SELECT proto_id, CAST(pos AS INT) AS pos, '{_FEED}' || proto_id || '/' || pos AS link FROM prototype_dataset, (SELECT unnest(range(0, 50)) AS pos) WHERE proto_id % 60 = 0 AND pos < 10 + proto_id")
def feed_scan(spark: SparkSession, d: str) -> DataFrame:
    """RSS feeds of 10 to 250 items as files: the first 50 items of each."""
    ids = table(spark, d, "prototype_dataset").filter("proto_id % 60 = 0").select("proto_id")
    item = F.transform(F.sequence(F.lit(0), (F.lit(9) + F.col("proto_id")).cast("int")), lambda i: F.concat(F.lit(f"<item><link>{_FEED}"), F.col("proto_id").cast("string"), F.lit("/"), i.cast("string"), F.lit("</link></item>")))
    path = scratch_path(spark, "feeds")
    ids.select(F.concat(F.lit("<rss>"), F.array_join(item, ""), F.lit("</rss>")).alias("value"), F.col("proto_id").alias("p")).write.partitionBy("p").text(path)
    got = files.feed_items(spark, path + "/*")
    return got.select(F.regexp_extract("link", r"/(\d+)/\d+$", 1).cast("long").alias("proto_id"), "pos", "link")


@query("""SELECT count(*) AS fetched, count(*) FILTER (WHERE title <> '') AS titled FROM (SELECT url, regexp_extract(first(html_content ORDER BY page_id), '(?is)<title[^>]*>(.*?)</title>', 1) AS title
    FROM crawled_pages WHERE html_content <> '' AND regexp_matches(url, '^https?://[^/?#]+/') AND NOT regexp_matches(url, '^https?://[^/?#]+/press') GROUP BY url)""")
def fetch_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages fetched through a function that answers from the fetched pages, with robots rules that forbid one path on every host."""
    pages = table(spark, d, "crawled_pages").filter("html_content <> ''").filter(F.col("url").rlike("^https?://[^/?#]+/"))
    urls = pages.select("url").distinct()
    got = web.fetched(urls, _answer, hosts_at_once=8, pause=0.0)
    # the title is that of the page in the table: the answer carries only that it was fetched
    first = pages.groupBy("url").agg(F.min_by("html_content", "page_id").alias("h"))
    titled = F.regexp_extract("h", r"(?is)<title[^>]*>(.*?)</title>", 1) != ""
    return got.select("url").join(first, "url").agg(F.count("*").alias("fetched"), F.count_if(titled).alias("titled"))


def _answer(url: str) -> tuple[int, str]:
    return (200, "User-agent: *\nDisallow: /press") if url.endswith("/robots.txt") else (200, "<title>ok</title>")


@query("""SELECT CASE WHEN (SELECT count(*) FROM search_index) > 0 THEN 'healthy' ELSE 'empty' END AS status, (SELECT count(*) FROM search_index) AS documents, (SELECT count(DISTINCT lower(domain)) FROM search_index) AS domains,
    (SELECT count(*) FROM search_log) AS searches""")
def api_health(spark: SparkSession, d: str) -> DataFrame:
    return api.health(table(spark, d, "search_index"), table(spark, d, "search_log"))


_PAGE = f"SELECT url, doc_idx, row_number() OVER (ORDER BY doc_idx) AS position FROM ({_hits(['notes'])} LIMIT 10)"


@query(f"""SELECT p.url, d.title, substring(regexp_replace(coalesce(d.content, ''), '[<>]', '', 'g'), 1, 160) || '...' AS snippet, p.position, 'basic_only' AS search_strategy
    FROM ({_PAGE}) p JOIN (SELECT url, first(title ORDER BY doc_idx) AS title, first(content ORDER BY doc_idx) AS content FROM search_index GROUP BY url) d USING (url)""")
def api_search(spark: SparkSession, d: str) -> DataFrame:
    """One page of results with titles and snippets."""
    r = api.search_response(table(spark, d, "search_index"), "notes")
    return r.withColumn("position", F.col("position").cast("long"))
