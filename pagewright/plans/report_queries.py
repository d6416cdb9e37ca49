"""Queries of search metrics and index quality, each with its SQL twin; and extras in Spark's own terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import reports as R
from pagewright.operators.rows import moving_average, quantiles
from pagewright.plans.runtime import table
from pagewright.streaming.metrics import hourly_metrics

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _cnt(c: str) -> str:
    return f"count(*) FILTER (WHERE coalesce({c}, false))"


@query(f"""SELECT count(*) AS total, {_cnt('success')} AS successful, count(*) - {_cnt('success')} AS failed, {_cnt('cache_hit')} AS hits, count(*) - {_cnt('cache_hit')} AS misses,
    {_cnt('semantic_used')} AS semantic, count(*) - {_cnt('semantic_used')} AS basic, round(100.0 * {_cnt('success')} / count(*), 2) AS success_rate,
    round(100.0 * {_cnt('cache_hit')} / count(*), 2) AS hit_rate, round(100.0 * {_cnt('semantic_used')} / count(*), 2) AS semantic_rate, round(avg(search_time_ms), 2) AS avg_ms FROM search_log""")
def metrics_counters(spark: SparkSession, d: str) -> DataFrame:
    return R.counters(table(spark, d, "search_log"))


@query("SELECT query, searches FROM (SELECT lower(query_text) AS query, count(*) AS searches, min(event_id) AS f FROM search_log WHERE query_text IS NOT NULL GROUP BY 1) ORDER BY searches DESC, f LIMIT 10")
def metrics_popular_top10(spark: SparkSession, d: str) -> DataFrame:
    return R.popular(table(spark, d, "search_log"))


@query("""SELECT event_id, round(avg(us) OVER (ORDER BY event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) / 1000, 6) AS moving_average
    FROM (SELECT event_id, CAST(round(search_time_ms * 1000) AS BIGINT) AS us FROM search_log)""")
def metrics_moving_avg_1000(spark: SparkSession, d: str) -> DataFrame:
    # whole microseconds, so that the sums are exact in any order
    us = table(spark, d, "search_log").select("event_id", F.round(F.col("search_time_ms") * 1000).cast("long").alias("us"))
    m = moving_average(us, "us", ["event_id"], 1000)
    return m.select("event_id", F.round(F.col("moving_average") / 1000, 6).alias("moving_average"))


@query("SELECT list(search_time_ms ORDER BY event_id) AS latencies FROM (SELECT event_id, search_time_ms FROM search_log WHERE search_time_ms IS NOT NULL ORDER BY event_id DESC LIMIT 10)")
def metrics_last10(spark: SparkSession, d: str) -> DataFrame:
    return R.last_values(table(spark, d, "search_log"))


@query("SELECT day, n, n - lag(n) OVER (ORDER BY day) AS delta FROM (SELECT CAST(added_at AS DATE) AS day, count(*) AS n FROM search_index WHERE added_at IS NOT NULL GROUP BY 1)")
def progress_delta(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "search_index").filter("added_at is not null").groupBy(F.to_date("added_at").alias("day")).agg(F.count("*").alias("n"))
    return R.growth(days, "day", "n")  # one row per day


@query("SELECT docs, round(100.0 * docs / 1000, 2) AS pct, greatest(1000 - docs, 0) AS remaining FROM (SELECT count(*) AS docs FROM search_index)")
def progress_report(spark: SparkSession, d: str) -> DataFrame:
    return R.progress(table(spark, d, "search_index"))


@query("""SELECT count(*) AS docs, round(avg(CASE WHEN isnan(coalesce(confidence, 0)) THEN NULL ELSE coalesce(confidence, 0) END), 6) AS avg_confidence,
    CAST(min(length(coalesce(content, ''))) AS INT) AS min_length, CAST(max(length(coalesce(content, ''))) AS INT) AS max_length, round(avg(length(coalesce(content, ''))), 6) AS avg_length FROM search_index""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return R.quality(table(spark, d, "search_index"))


@query("SELECT domain, docs FROM (SELECT coalesce(domain, '') AS domain, count(*) AS docs, min(doc_idx) AS f FROM search_index GROUP BY 1) ORDER BY docs DESC, f LIMIT 10")
def quality_domain_top10(spark: SparkSession, d: str) -> DataFrame:
    return R.top_domains(table(spark, d, "search_index"))


_JUDGED = "(SELECT doc_idx, coalesce(is_personal, 0) AS t, CAST(coalesce(confidence, 0) >= 0.6 AS INT) AS p FROM search_index)"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    # NaN counts as greatest in both engines
    return table(spark, d, "search_index").select("doc_idx", "is_personal", (F.coalesce("confidence", F.lit(0.0)) >= 0.6).cast("int").alias("predicted"))


@query(f"""SELECT *, CASE WHEN tp + fp + fn + tn > 0 THEN round((tp + tn) * 1.0 / (tp + fp + fn + tn), 6) ELSE 0 END AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp * 1.0 / (tp + fp), 6) ELSE 0 END AS precision,
    CASE WHEN tp + fn > 0 THEN round(tp * 1.0 / (tp + fn), 6) ELSE 0 END AS recall, CASE WHEN tp + fn > 0 THEN round(tp * 1.0 / (tp + fn), 6) ELSE 0 END AS legacy_precision FROM (
    SELECT count(*) FILTER (WHERE t = 1 AND p = 1) AS tp, count(*) FILTER (WHERE t <> 1 AND p = 1) AS fp, count(*) FILTER (WHERE t = 1 AND p <> 1) AS fn, count(*) FILTER (WHERE t <> 1 AND p <> 1) AS tn FROM {_JUDGED})""")
def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.validation(_judged(spark, d), "is_personal", "predicted")


@query(f"SELECT doc_idx, CASE WHEN t = 1 THEN 'missed personal' ELSE 'false personal' END AS direction FROM {_JUDGED} WHERE t <> p ORDER BY doc_idx LIMIT 5")
def misclassified_first5(spark: SparkSession, d: str) -> DataFrame:
    return R.misclassified(_judged(spark, d), "is_personal", "predicted", "doc_idx").select("doc_idx", "direction")


@query()
def quality_sample50(spark: SparkSession, d: str) -> DataFrame:
    """Fifty documents drawn by hash, the same each time."""
    return R.sample(table(spark, d, "search_index"), 50, "doc_idx").select("doc_idx", "url", "title")


@query("""SELECT r.page_id, max(r.confidence) AS confidence, any_value(p.status_code) AS status_code, count(*) AS queued FROM review_candidates r JOIN crawled_pages p USING (page_id) GROUP BY r.page_id""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "review_candidates").groupBy("page_id").agg(F.max("confidence").alias("confidence"), F.count("*").alias("queued"))
    return r.join(table(spark, d, "crawled_pages").select("page_id", "status_code"), "page_id").select("page_id", "confidence", "status_code", "queued")


# beyond the reference, in Spark's own terms


@query("""SELECT hour, searches, failed, total_ms FROM (SELECT date_trunc('hour', searched_at) AS hour, count(*) AS searches, count(*) FILTER (WHERE NOT coalesce(success, false)) AS failed,
    round(sum(search_time_ms), 3) AS total_ms FROM search_log WHERE searched_at IS NOT NULL GROUP BY 1)
    WHERE hour + INTERVAL 1 HOUR <= (SELECT max(searched_at) FROM search_log) - INTERVAL 10 MINUTE""")
def metrics_stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    """The log as a stream: hours closed by the watermark."""
    return hourly_metrics(spark, f"{d}/search_log.parquet")


@query("""SELECT coalesce(lower(domain), '') AS domain, coalesce(stage_used, '') AS stage_used, count(*) AS docs, CAST(grouping(domain) AS INT) AS all_domains, CAST(grouping(stage_used) AS INT) AS all_stages
    FROM (SELECT coalesce(lower(domain), '?') AS domain, coalesce(stage_used, '?') AS stage_used FROM search_index) GROUP BY ROLLUP (domain, stage_used)""")
def domain_stage_rollup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "search_index").select(F.coalesce(F.lower("domain"), F.lit("?")).alias("domain"), F.coalesce("stage_used", F.lit("?")).alias("stage_used"))
    g = t.rollup("domain", "stage_used").agg(F.count("*").alias("docs"), F.grouping("domain").cast("int").alias("all_domains"), F.grouping("stage_used").cast("int").alias("all_stages"))
    return g.select(F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("stage_used", F.lit("")).alias("stage_used"), "docs", "all_domains", "all_stages")


@query("""SELECT quantile_cont(search_time_ms, 0.5) AS p50, quantile_cont(search_time_ms, 0.95) AS p95, quantile_cont(search_time_ms, 0.99) AS p99 FROM search_log WHERE search_time_ms IS NOT NULL AND NOT isnan(search_time_ms)""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles from a distributed rank: only the two rows around each quantile reach the last stage."""
    t = table(spark, d, "search_log").filter("search_time_ms is not null and not isnan(search_time_ms)").select("search_time_ms")
    return quantiles(t, "search_time_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
