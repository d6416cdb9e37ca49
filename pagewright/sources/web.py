"""Fetching pages through a function the caller supplies, with robots rules and a pause per host."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions import urls as U

#: (status, body) of an address.
Fetcher = Callable[[str], tuple[int, str]]
AGENT = "pagewright"


def http_fetcher(timeout: float = 10.0) -> Fetcher:
    """A fetcher over the standard library."""
    import urllib.request

    def fetch(url: str) -> tuple[int, str]:
        request = urllib.request.Request(url, headers={"User-Agent": AGENT})
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")

    return fetch


def allowed(rules: str | None, url: str, agent: str = AGENT) -> bool:
    """Whether robots rules allow an address; missing rules allow everything."""
    if rules is None:
        return True
    p = RobotFileParser()
    p.parse(rules.splitlines())
    return p.can_fetch(agent, url)


def fetched(urls: DataFrame, fetch: Fetcher, hosts_at_once: int = 64, pause: float = 1.0, robots: bool = True) -> DataFrame:
    """(url, domain, status_code, title, html_content) of the urls that answer 200 and that robots rules allow.

    A host's urls are spread by host over ``hosts_at_once`` partitions, so its pause holds; its robots rules are
    read once. Failed, refused and null urls are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules: dict[str, str | None] = {}
        last: dict[str, float] = {}

        def get(url: str, host: str) -> tuple[int, str]:
            wait = last.get(host, -pause) + pause - time.monotonic()
            if wait > 0:
                time.sleep(wait)
            try:
                return fetch(url)
            except Exception:
                return 0, ""
            finally:
                last[host] = time.monotonic()

        for b in batches:
            out = []
            for url in b.url:
                parts = urlsplit(url)
                host = parts.netloc
                if robots and host not in rules:
                    status, text = get(f"{parts.scheme}://{host}/robots.txt", host)
                    rules[host] = text if status == 200 else None
                if robots and not allowed(rules[host], url):
                    continue
                status, body = get(url, host)
                if status == 200:
                    out.append((url, host, status, body))
            yield pd.DataFrame(out, columns=["url", "domain", "status_code", "html_content"])

    spread = urls.filter("url is not null").select("url").distinct().repartition(hosts_at_once, U.raw_netloc(F.col("url")))
    got = spread.mapInPandas(run, "url string, domain string, status_code int, html_content string")
    return got.select("url", "domain", "status_code", H.title(F.col("html_content")).alias("title"), "html_content")
