"""Inverted index and keyword search."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as X
from pagewright.operators.rows import page_of


def postings(docs: DataFrame, key: str, text: str, limit: int | None = None) -> DataFrame:
    """(term, key, tf): one row per term and document. ``limit`` indexes the first characters only. Null texts have no terms."""
    t = F.coalesce(F.col(text), F.lit(""))
    t = F.substring(t, 1, limit) if limit else t
    return docs.select(F.col(key), F.explode(X.tokens(t)).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def dictionary(posts: DataFrame) -> DataFrame:
    """(term, docs, occurrences) of every term."""
    return posts.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


def query_terms(query: str) -> list[str]:
    return sorted({w for w in query.lower().split() if len(w) > 2})


def matching(docs: DataFrame, query: str, title: str = "title") -> DataFrame:
    """Documents whose title holds every query term, by a scan; a query without usable terms matches none."""
    terms = query_terms(query)
    if not terms:
        return docs.limit(0)
    return docs.filter(F.size(F.array_except(F.array(*map(F.lit, terms)), X.tokens(F.col(title)))) == 0)


def matching_by_index(posts: DataFrame, docs: DataFrame, query: str, key: str) -> DataFrame:
    """The same over a written index: only the postings of the query's terms are read (pushed down to the scan)."""
    terms = query_terms(query)
    if not terms:
        return docs.limit(0)
    hits = posts.filter(F.col("term").isin(terms)).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") == len(terms)).select(key)
    return docs.join(hits, key, "left_semi")


def score(df: DataFrame, query: str, title: str = "title") -> DataFrame:
    """Adds ``score``: the number of query terms inside the title."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return df.withColumn("score", sum((F.when(low.contains(t), 1).otherwise(0) for t in query_terms(query)), F.lit(0)))


def in_domain(df: DataFrame, docs: DataFrame, domain: str | None, strict: bool = False) -> DataFrame:
    """Rows of a domain (lower case, exact). A domain no document has filters nothing, unless ``strict``."""
    if not domain:
        return df
    d = domain.lower()
    if strict:
        return df.filter(F.lower("domain") == d)
    known = docs.filter(F.lower("domain") == d).limit(1).agg((F.count("*") > 0).alias("known"))
    return df.crossJoin(F.broadcast(known)).filter(~F.col("known") | (F.lower("domain") == d)).drop("known")  # one row


def search(docs: DataFrame, query: str, domain: str | None = None, limit: int = 10, page: int = 1, key: str = "doc_idx", strict_domain: bool = False) -> DataFrame:
    """Conjunctive title search: score, then key; one page. Raises ValueError for limit or page below 1."""
    hits = score(in_domain(matching(docs, query), docs, domain, strict_domain), query)
    return page_of(hits, [F.desc("score"), F.asc(key)], page, limit)


def search_summary(docs: DataFrame, query: str, domain: str | None = None, limit: int = 10, page: int = 1) -> DataFrame:
    """One row: query, total_results, page, total_pages, search_type. Totals are those before any merge or deduplication."""
    if limit < 1 or page < 1:
        raise ValueError("limit and page must be at least 1")
    hits = in_domain(matching(docs, query), docs, domain)
    n = hits.agg(F.count("*").alias("total_results"))
    return n.select(F.lit(query).alias("query"), "total_results", F.lit(page).alias("page"), F.ceil(F.col("total_results") / limit).alias("total_pages"), F.lit("strict_and").alias("search_type"))


def page_links(page: int, pages: int) -> list[int]:
    """Page numbers that a result list links to: two before and two after the current one."""
    return list(range(max(1, page - 2), min(pages, page + 2) + 1))


def pages_of(total: int, limit: int) -> int:
    return math.ceil(total / limit)
