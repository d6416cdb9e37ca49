"""The source of a row: its domain, or the host of its address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_of(domain: Column, url: Column) -> Column:
    """``domain``, or the host of ``url`` where domain is null or blank; lower case, no port, no leading ``www.``.

    Rows with neither share the source ``''``.
    """
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1)
    name = F.coalesce(F.nullif(F.trim(domain), F.lit("")), host)
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r":\d*$", ""), r"^www\.", "")


SOURCE_SQL = r"""regexp_replace(regexp_replace(lower(trim(coalesce(nullif(trim(domain), ''),
    regexp_extract(coalesce(url, ''), '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)', 1)))), ':\d*$', ''), '^www\.', '')"""
