"""Links, feeds and crawl order over pages that are already fetched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions import lexicon as L
from pagewright.functions import urls as U
from pagewright.plans.runtime import materialize


def same_site_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html_content") -> DataFrame:
    """(key, link): distinct links to the page's own host, without fragments. Null html has none."""
    links = pages.select(key, F.col(url).alias("base"), F.explode(H.hrefs(F.col(html))).alias("href"))
    full = F.regexp_replace(U.absolute(F.col("base"), F.col("href")), "#.*$", "")
    links = links.select(key, U.raw_netloc(F.col("base")).alias("host"), full.alias("link"))
    return links.filter((U.raw_netloc(F.col("link")) == F.col("host")) & (F.col("host") != "")).select(key, "link").distinct()


def blogroll_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html_content") -> DataFrame:
    """(key, link): anchors whose text names a blogroll and whose target is absolute or root-relative, without social hosts and the own host."""
    a = pages.select(key, F.col(url).alias("base"), F.explode(H.anchors(F.col(html))).alias("a")).select(key, "base", "a.*")
    named = reduce(lambda x, y: x | y, [F.col("text").contains(t) for t in L.BLOGROLL_TEXTS])
    a = a.filter(named & (F.col("href").startswith("http") | F.col("href").startswith("/")))
    return _other_hosts(a.select(key, U.raw_netloc(F.col("base")).alias("host"), U.absolute(F.col("base"), F.col("href")).alias("link")), key)


def _other_hosts(links: DataFrame, key: str) -> DataFrame:
    host = U.raw_netloc(F.col("link"))
    skipped = reduce(lambda x, y: x | y, [host.contains(s) for s in L.SKIPPED_HOSTS])
    return links.filter(~skipped & (host != F.col("host"))).select(key, "link").distinct()


def links_of_subpages(pages: DataFrame, mark: str, texts: tuple[str, ...] = (), key: str = "page_id", url: str = "url", html: str = "html_content") -> DataFrame:
    """(key, link): absolute links found on the subpages that a page's marked anchors lead to.

    An anchor is marked if ``mark``, a regular expression, matches its target or text in lower case; a subpage is a row of ``pages``
    under the resolved target. With ``texts`` only links whose text holds one of them count. An about page is
    ``mark='about'`` with :data:`ABOUT_TEXTS`, a page of favourites ``mark='favorites?|reading'`` without texts.
    """
    a = pages.select(key, F.col(url).alias("base"), F.explode(H.anchors(F.col(html))).alias("a")).select(key, "base", "a.*")
    marked = a.filter(F.lower("href").rlike(mark) | F.col("text").rlike(mark))
    targets = marked.select(key, F.regexp_replace(U.absolute(F.col("base"), F.col("href")), "#.*$", "").alias("base")).distinct()
    wanted = a.filter(F.col("href").startswith("http"))
    if texts:
        wanted = wanted.filter(reduce(lambda x, y: x | y, [F.col("text").contains(t) for t in texts]))
    return targets.join(wanted.select("base", F.col("href").alias("link")), "base").select(key, "link").distinct()


def harvest(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html_content", status: str = "status_code") -> DataFrame:
    """(host, link): what the pages of each host lead to: anchors that name a blogroll, links of about pages, links of pages of favourites.

    Only pages with status 200 count; social hosts and the own host are left out, and each link comes once per host. Hosts are
    worked on side by side, as one plan over all pages.
    """
    ok = pages.filter(F.col(status) == 200)
    a = blogroll_links(ok, key, url, html)
    b = links_of_subpages(ok, "about", ABOUT_TEXTS, key, url, html)
    c = links_of_subpages(ok, "favorites?|reading", (), key, url, html)
    found = a.unionByName(b).unionByName(c).join(ok.select(key, U.raw_netloc(F.col(url)).alias("host")), key).filter("host <> ''")
    return _other_hosts(found, "host")


def harvest_summary(hosts: DataFrame, links: DataFrame) -> DataFrame:
    """One row: hosts processed, hosts with links, links (host by host), distinct links. ``hosts`` has (host), ``links`` is of :func:`harvest`."""
    n = hosts.agg(F.count_distinct("host").alias("domains_processed"))
    # the distinct links are counted after a distinct of their own, so that no task holds all of them
    a = links.groupBy("host").agg(F.count("*").alias("n")).agg(F.count("*").alias("domains_with_blogrolls"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_blogroll_links"))
    b = links.select("link").distinct().agg(F.count("*").alias("unique_blogroll_links"))
    return n.crossJoin(a).crossJoin(b)  # one row each


def enhanced_crawl(pages: DataFrame, documents: DataFrame, limit: int = 50, url: str = "url", html: str = "html_content") -> DataFrame:
    """(host, link): the links of all feeds of a host, each once: feed discovery, then the first ``limit`` items of every feed found.

    ``documents`` (url, xml, status_code) holds what was fetched from feed addresses; addresses without a document of status 200 give nothing.
    """
    fetched = documents.filter("status_code = 200 and xml is not null").select(F.col("url").alias("feed"), F.explode(F.slice(H.feed_links(F.col("xml")), 1, limit)).alias("link"))
    return feeds(pages, url, html).join(fetched, "feed").select("host", "link").distinct()


def indexed_hosts(docs: DataFrame, url: str = "url") -> DataFrame:
    """(host): the distinct authorities of the index, as written; urls without one are left out."""
    return docs.select(U.raw_netloc(F.col(url)).alias("host")).filter("host <> ''").distinct()


#: Words in the texts of links on an about page that may lead to a person's other sites.
ABOUT_TEXTS = ("blog", "site", "personal", "writing", "author")


def outgoing_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html_content") -> DataFrame:
    """(key, link): distinct absolute links to other hosts that may be blogs."""
    a = pages.select(key, U.raw_netloc(F.col(url)).alias("host"), F.explode(H.hrefs(F.col(html))).alias("link")).filter(F.col("link").startswith("http"))
    return _other_hosts(a, key)


def feeds(pages: DataFrame, url: str = "url", html: str = "html_content", answers: DataFrame | None = None) -> DataFrame:
    """(host, feed): feed links of the pages of a host, and the usual places, each once. Rows without a host are left out.

    With ``answers`` (url, status_code) only those usual places count that answered 200; without, all of them do.
    """
    root = F.concat(F.lit("https://"), F.col("host"))
    base = pages.select(U.raw_netloc(F.col(url)).alias("host"), F.col(html).alias("html")).filter("host <> ''")
    declared = F.regexp_extract_all("html", F.lit(r"(?is)(<link\b[^>]*type\s*=\s*[\"']application/(?:rss|atom)\+xml[\"'][^>]*>)"), F.lit(1))
    href = F.regexp_extract(F.col("tag"), r"(?is)href\s*=\s*[\"']([^\"']+)[\"']", 1)
    found = base.select("host", F.explode(declared).alias("tag")).select("host", href.alias("h")).filter("h <> ''")
    found = found.select("host", F.when(F.col("h").startswith("/"), F.concat(root, F.col("h"))).otherwise(F.col("h")).alias("feed"))
    usual = base.select("host").distinct().select("host", F.explode(F.array(*[F.concat(root, F.lit(p)) for p in L.FEED_PATHS])).alias("feed"))
    if answers is not None:
        usual = usual.join(answers.filter("status_code = 200").select(F.col("url").alias("feed")), "feed", "left_semi").select("host", "feed")
    return found.unionByName(usual).distinct()


def crawl_order(pages: DataFrame, seeds: DataFrame, max_pages: int, per_page: int = 5, max_levels: int = 50) -> DataFrame:
    """(url, level, position): breadth-first order from ``seeds`` (url) over ``pages`` (url, links array<string>), at most ``max_pages`` pages.

    Links of a page are taken in lexicographic order, the first ``per_page`` of them; a page is visited when its
    url is among ``pages``. Equals a first-in-first-out queue: levels are ordered by parent, then link.
    """
    if max_pages < 1:
        raise ValueError("max_pages must be at least 1")
    spark = pages.sparkSession
    links = materialize(pages.groupBy("url").agg(F.min("links").alias("links")).select("url", F.slice(F.array_sort(F.array_distinct(F.coalesce("links", F.array().cast("array<string>")))), 1, per_page).alias("links")), "crawl-links")
    frontier = seeds.select("url").distinct().join(links.select("url"), "url", "left_semi").select("url", F.array(F.lit(0)).cast("array<int>").alias("path"), F.col("url").alias("first"))
    visited, done, total, level = None, [], 0, 0
    while level < max_levels and total < max_pages:
        step = frontier.groupBy("url").agg(F.min(F.struct("path", "first")).alias("at"))
        if visited is not None:
            step = step.join(visited, "url", "left_anti")
        # positions within a level: at most max_pages rows remain after the cut
        cut = step.orderBy("at.path", "at.first", "url").limit(max_pages - total)
        rows = [(r.url, level) for r in cut.orderBy("at.path", "at.first", "url").collect()]
        if not rows:
            break
        now = spark.createDataFrame([(u, lv, total + i + 1) for i, (u, lv) in enumerate(rows)], "url string, level int, position int")
        done.append(now)
        total += len(rows)
        visited = reduce(DataFrame.unionByName, done).select("url")
        frontier = (
            now.join(links, "url")
            .select("position", F.posexplode("links").alias("k", "link"))
            .select(F.col("link").alias("url"), F.array("position", "k").alias("path"), F.col("link").alias("first"))
            .join(links.select("url"), "url", "left_semi")
        )
        level += 1
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], "url string, level int, position int")


def links_of(json_links: Column) -> Column:
    """array<string> of a JSON array; null for null or broken JSON."""
    return F.from_json(json_links, "array<string>")
