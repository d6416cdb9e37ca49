"""Text expressions; all built in. Null texts give null unless stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import lexicon as L


def clean(text: Column, limit: int = 1500) -> Column:
    """White space collapsed, trimmed, cut to ``limit`` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def preprocess(text: Column) -> Column:
    """Lower case, tags as blanks, white space collapsed; null gives ''."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "<[^>]+>", " "), r"\s+", " "))


def representation(title: Column, domain: Column, description: Column, content: Column) -> Column:
    """The labelled parts that are not empty, joined by bars; content cut to 800 characters."""

    def part(label: str, c: Column) -> Column:
        return F.when(c != "", F.concat(F.lit(f"{label}: "), c))

    return F.concat_ws(" | ", part("Title", clean(title)), part("Domain", domain), part("Description", clean(description)), part("Content", F.substring(clean(content), 1, 800)))


def embedding_text(title: Column, content: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(content, F.lit("")), 1, 500))


def tokens(text: Column) -> Column:
    """Lower-case words longer than two characters, split at white space, punctuation kept; null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.length(w) > 2)


def repair(text: Column, table: tuple[tuple[str, str], ...] = L.MOJIBAKE, fixed: bool = False) -> Column:
    """Garbled sequences replaced in order; ``fixed`` tries longer ones first, so that none hides another."""
    order = sorted(table, key=lambda kv: -len(kv[0])) if fixed else table
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), order, text)


def repair_all(df: DataFrame, fixed: bool = False) -> DataFrame:
    """:func:`repair` on every string column."""
    return df.select(*[repair(F.col(f"`{f.name}`"), fixed=fixed).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def snippet(content: Column) -> Column:
    """What a result list shows: no angle brackets, 160 characters and dots."""
    return F.concat(F.substring(F.regexp_replace(F.coalesce(content, F.lit("")), "[<>]", ""), 1, 160), F.lit("..."))


def default(c: Column, value: object) -> Column:
    return F.coalesce(c, F.lit(value))
