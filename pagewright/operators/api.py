"""What a search service answers with, as one-row tables: search responses, health, domains and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as X
from pagewright.operators import index, reports, vectors


def search_response(docs: DataFrame, query: str, limit: int = 10, page: int = 1, domain: str | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """(url, title, snippet, position, search_strategy): one page of results.

    With ``semantic`` (url, pos) and fewer than 0.8 * limit basic results, semantic ones fill the page.
    """
    basic = index.search(docs, query, domain, limit, page)
    low = [c for c in ("url", "title", "content") if c in docs.columns]
    if semantic is None:
        rows = basic.select("url", F.lit(0).alias("src"), F.col("doc_idx").alias("pos"))
    else:
        rows = vectors.fallback_merge(basic.select("url", F.col("doc_idx").alias("pos")), semantic, limit)
    # only the rows of the page's own urls are looked up: at most `limit` urls, pushed to the scan side as a semi-join
    best = docs.select("doc_idx", *low).join(F.broadcast(rows.select("url")), "url", "left_semi").groupBy("url").agg(F.min_by(F.struct("title", "content"), "doc_idx").alias("d"))
    strategy = F.when(F.max("src").over(_all()) > 0, "basic_with_semantic_fallback").otherwise("basic_only")
    place = F.row_number().over(_all().orderBy("src", "pos"))
    return rows.join(best, "url", "left").select("url", F.col("d.title").alias("title"), X.snippet(F.col("d.content")).alias("snippet"), place.alias("position"), strategy.alias("search_strategy"))


def _all():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # at most one page of rows


def health(docs: DataFrame, log: DataFrame) -> DataFrame:
    """One row: status, documents, domains, searches so far."""
    a = docs.agg(F.count("*").alias("documents"), F.count_distinct(F.lower("domain")).alias("domains"))
    b = log.agg(F.count("*").alias("searches"))
    return a.crossJoin(b).select(F.when(F.col("documents") > 0, "healthy").otherwise("empty").alias("status"), "*")


def domains(docs: DataFrame) -> DataFrame:
    return docs.filter("domain <> ''").select(F.lower("domain").alias("domain")).distinct().orderBy("domain")


def metrics(log: DataFrame) -> DataFrame:
    """Counters, the popular queries and the last latencies in one row."""
    top = reports.popular(log).agg(F.collect_list(F.struct("query", "searches")).alias("popular"))
    return reports.counters(log).crossJoin(top).crossJoin(reports.last_values(log))
