"""Taking in new pages: known urls, merge by key, and reports on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import urls as U
from pagewright.operators.rows import keep_first
from pagewright.plans.runtime import materialize


def new_urls(candidates: DataFrame, indexed: DataFrame, url: str = "url", order: str = "pos") -> DataFrame:
    """Candidates not indexed under the ingest form of their url; of several equal ones the first by ``order``. Null urls are dropped."""
    c = candidates.filter(F.col(url).isNotNull()).withColumn("_key", U.ingest_key(F.col(url)))
    known = indexed.filter(F.col(url).isNotNull()).select(U.ingest_key(F.col(url)).alias("_key")).distinct()
    return keep_first(c.join(known, "_key", "left_anti"), ["_key"], [F.col(order)]).drop("_key")


def upsert(existing: DataFrame, changes: DataFrame, key: str, version: list[str]) -> DataFrame:
    """Both tables with one row per key: the one with the highest version columns, nulls lowest. Columns missing on a side are null."""
    both = existing.unionByName(changes, allowMissingColumns=True)
    cols = [c for c in both.columns if c != key]
    latest = F.max_by(F.struct(*cols), F.struct(*[F.struct(F.col(v).isNotNull(), F.col(v)) for v in version])).alias("_row")
    return both.groupBy(key).agg(latest).select(*[F.col(key) if c == key else F.col(f"_row.`{c}`").alias(c) for c in both.columns])


def pipeline(candidates: DataFrame, indexed: DataFrame, pages: DataFrame, order: str = "pos", thresholds=None) -> DataFrame:  # noqa: ANN001
    """(url, order, route, reason, confidence): what becomes of each candidate (url, order): known url, path filter, page, cascade, routing.

    ``indexed`` has (url), ``pages`` (url, html_content), of which the smallest page with content by ``order`` counts. A later candidate of the same
    normal url is a duplicate of the first. Routes: duplicate, prefiltered, no_content, add, review, reject. Null urls are dropped.
    """
    from pagewright.operators import classify as C

    c = candidates.filter("url is not null").select("url", order, U.ingest_key(F.col("url")).alias("_key"))
    first = c.groupBy("_key").agg(F.min(order).alias("_first"))
    known = indexed.filter("url is not null").select(U.ingest_key(F.col("url")).alias("_key")).distinct().withColumn("_known", F.lit(True))
    # one row per key after the aggregate, so a key with many candidates costs one row per task
    fate = first.join(known, "_key", "left").withColumn("_known", F.col("_known").isNotNull())
    new = c.join(fate, "_key").withColumn("_dup", F.col("_known") | (F.col(order) > F.col("_first"))).withColumn("_pre", U.prefilter(F.col("url")))
    new = materialize(new.select("url", order, "_dup", "_pre.keep", "_pre.reason"), "ingest")
    taken = new.filter("not _dup and keep")
    html = pages.filter(F.length("html_content") > 0).groupBy("url").agg(F.min_by("html_content", order).alias("html_content"))
    fetched = taken.join(html, "url", "left")
    judged = C.classify(fetched.filter("html_content is not null"), order, "url", None, "html_content", thresholds=thresholds or C.OBSERVED)
    route = F.when(F.col("_dup"), "duplicate").when(~F.col("keep"), "prefiltered").when(F.col("stage_used").isNull(), "no_content").otherwise(C.route(F.col("is_personal"), F.col("confidence")))
    reason = F.when(F.col("_dup"), "Already indexed").otherwise(F.col("reason"))
    return new.join(judged, order, "left").select("url", order, route.alias("route"), reason.alias("reason"), "confidence")


def pipeline_summary(routed: DataFrame) -> DataFrame:
    """One row: candidates per route, and the share of added ones among those neither duplicate nor filtered by path (0 if none is left)."""
    n = {r: F.count_if(F.col("route") == r) for r in ("duplicate", "prefiltered", "add", "review")}
    rejected = F.count_if(F.col("route").isin("reject", "no_content"))
    left = F.count("*") - n["duplicate"] - n["prefiltered"]
    return routed.agg(
        F.count("*").alias("candidates"), n["prefiltered"].alias("prefiltered"), n["duplicate"].alias("duplicates"), n["add"].alias("added"), n["review"].alias("review"), rejected.alias("rejected"),
        F.when(left > 0, n["add"] / left * 100).otherwise(0.0).alias("success_rate"),
    )


def build_index(classified: DataFrame) -> DataFrame:
    """Documents for the index: those judged personal (null and 0 are not) whose content is not empty, with the length of their content."""
    return classified.filter((F.coalesce(F.col("is_personal").cast("int"), F.lit(0)) == 1) & (F.col("content") != "")).withColumn("content_length", F.length("content"))


def summary(routed: DataFrame, total: int | None = None) -> DataFrame:
    """(route, rows, share): rows per route and their share of all of them, or of ``total``."""
    n = routed.agg(F.count("*").alias("n")) if total is None else routed.sparkSession.range(1).select(F.lit(total).alias("n"))
    return routed.groupBy("route").agg(F.count("*").alias("rows")).crossJoin(F.broadcast(n)).select("route", "rows", F.when(F.col("n") > 0, F.col("rows") / F.col("n")).otherwise(0.0).alias("share"))


def dedup_report(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, and rows that a deduplication by ``key`` removes; null is a key of its own."""
    k = F.coalesce(F.col(key), F.lit("\x00"))
    return df.agg(F.count("*").alias("rows"), F.count_distinct(k).alias("kept")).withColumn("removed", F.col("rows") - F.col("kept"))
