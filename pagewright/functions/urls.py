"""URL expressions: normal forms, hosts and link resolution. All are built-in expressions except :func:`absolute`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import lexicon as L

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def raw_netloc(url: Column) -> Column:
    """Authority as written, with port and user; '' if there is none, null for null."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def canonical_domain(url: Column) -> Column:
    """Authority in lower case without a leading ``www.``."""
    return F.regexp_replace(F.lower(raw_netloc(url)), r"^www\.", "")


def extracted_domain(url: Column) -> Column:
    """Authority as written without a leading ``www.``; 'unknown' for null."""
    return F.coalesce(F.regexp_replace(raw_netloc(url), r"^www\.", ""), F.lit("unknown"))


def _path(url: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), r"^//[^/?#]*", "")
    return F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r";[^/]*$", "")


def is_tracking(name: Column) -> Column:
    n = F.lower(name)
    cond = n.isin(*L.TRACKING_NAMES)
    for p in L.TRACKING_PREFIXES:
        cond = cond | n.startswith(p)
    return cond


def normalize(url: Column) -> Column:
    """The form by which search results count as one.

    Scheme (http by default) and host in lower case, no leading ``www.``, no default port, no
    trailing ``index.html`` or slash, no tracking or empty-valued parameters, the others sorted
    by name and value and encoded anew, no fragment. Null and empty urls come back unchanged.
    """
    s = F.when(scheme(url) == "", F.lit("http")).otherwise(scheme(url))
    host = canonical_domain(url)
    host = F.when(s == "http", F.regexp_replace(host, ":80$", "")).when(s == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    p = F.when(_path(url) == "", F.lit("/")).otherwise(_path(url))
    p = F.regexp_replace(p, r"index\.html$", "")
    p = F.when((p == "") | p.rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(p, "/+$", ""))
    query = F.split(F.regexp_extract(F.regexp_replace(url, "#.*$", ""), r"\?(.*)$", 1), "&")

    def decode(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(x), x)

    pairs = F.transform(query, lambda kv: F.struct(decode(F.regexp_extract(kv, "^([^=]*)", 1)).alias("k"), decode(F.regexp_extract(kv, "^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda x: (x["v"] != "") & ~is_tracking(x["k"])))
    q = F.array_join(F.transform(kept, lambda x: F.concat(encode(x["k"]), F.lit("="), encode(x["v"]))), "&")
    full = F.concat(s, F.lit("://"), host, p, F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))
    return F.when(url == "", url).otherwise(full)


def encode(x: Column) -> Column:
    """Form encoding that leaves ``~`` and encodes ``*``."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def ingest_key(url: Column) -> Column:
    """The form by which the ingest recognises known urls: no query, fragment or trailing slash, all in lower case."""
    base = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^(.*)$", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(base, r";[^/]*$", ""), "/+$", ""))


def prefilter(url: Column) -> Column:
    """struct(keep, reason): the first path that marks a company page rejects, else the first that marks a blog is named."""
    low = F.lower(url)

    def first(paths: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.when(low.rlike(p) if "[" in p else low.contains(p), F.lit(p)) for p in paths])

    bad, good = first(L.PATHS_CORPORATE), first(L.PATHS_BLOG)
    reason = F.when(bad.isNotNull(), F.concat(F.lit("Corporate pattern: "), bad)).when(good.isNotNull(), F.concat(F.lit("Blog pattern: "), good)).otherwise("No clear pattern")
    return F.struct(bad.isNull().alias("keep"), reason.alias("reason"))


@F.pandas_udf(T.StringType())
def _join(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from urllib.parse import urljoin

    def one(base: str | None, ref: str | None) -> str | None:
        if base is None or ref is None:
            return None
        try:
            return urljoin(base, ref)
        except ValueError:
            return None

    for base, ref in parts:
        yield pd.Series([one(b, r) for b, r in zip(base, ref)], dtype=object)


def absolute(base: Column, href: Column) -> Column:
    """``href`` resolved against ``base``; root-relative and absolute links stay in the JVM, only the rest goes to Python."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    simple = href.rlike(r"^/(?!/)") & (root != "") & ~href.contains("/.")
    full = href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/") & ~href.contains("/.")
    return F.when(simple, F.concat(root, href)).when(full, href).otherwise(_join(F.when(~(simple | full), base), F.when(~(simple | full), href)))
