"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import bpe, caps, encoding, history, lines, mainbody, packing, residue, shared, sigtree

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (mainbody, sigtree, lines, caps, history, residue, encoding, bpe, packing, shared)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out.update(getattr(m, "ORACLE_SQL", {}))
    return out
