"""Search metrics and index quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100 * part / whole, 2)).otherwise(0.0)


def counters(log: DataFrame) -> DataFrame:
    """One row of counts and rates of (success, cache_hit, semantic_used, search_time_ms); null flags count as false."""
    n = F.count("*")
    ok, hit, sem = (F.count_if(F.coalesce(c, F.lit(False))) for c in ("success", "cache_hit", "semantic_used"))
    return log.agg(
        n.alias("total"), ok.alias("successful"), (n - ok).alias("failed"), hit.alias("hits"), (n - hit).alias("misses"), sem.alias("semantic"), (n - sem).alias("basic"),
        _pct(ok, n).alias("success_rate"), _pct(hit, n).alias("hit_rate"), _pct(sem, n).alias("semantic_rate"), F.round(F.avg("search_time_ms"), 2).alias("avg_ms"),
    )


def popular(log: DataFrame, k: int = 10, query: str = "query_text", seq: str = "event_id") -> DataFrame:
    """(query, searches): the ``k`` most frequent queries in lower case, ties by first appearance; null queries are left out."""
    g = log.filter(F.col(query).isNotNull()).groupBy(F.lower(query).alias("query")).agg(F.count("*").alias("searches"), F.min(seq).alias("first"))
    return g.orderBy(F.desc("searches"), "first").limit(k).select("query", "searches")


def last_values(log: DataFrame, k: int = 10, value: str = "search_time_ms", seq: str = "event_id") -> DataFrame:
    """One row: the last ``k`` values, oldest first; nulls are left out."""
    top = log.filter(F.col(value).isNotNull()).orderBy(F.desc(seq)).limit(k)
    pairs = F.array_sort(F.collect_list(F.struct(seq, value)))  # at most k
    return top.agg(F.transform(pairs, lambda p: p[value]).alias("latencies"))


def growth(counts: DataFrame, at: str, n: str) -> DataFrame:
    """Adds ``delta`` to a table of snapshots: the change of ``n`` since the one before."""
    return counts.withColumn("delta", F.col(n) - F.lag(n).over(Window.orderBy(at)))


def progress(docs: DataFrame, target: int = 1000) -> DataFrame:
    """One row: documents, per cent of the target, documents still to go."""
    return docs.agg(F.count("*").alias("docs")).select("docs", F.round(100 * F.col("docs") / target, 2).alias("pct"), F.greatest(F.lit(target) - F.col("docs"), F.lit(0)).alias("remaining"))


def quality(docs: DataFrame) -> DataFrame:
    """One row: documents, mean confidence (null counts 0, NaN is left out), and least, greatest and mean content length."""
    conf = F.when(~F.isnan(F.coalesce("confidence", F.lit(0.0))), F.coalesce("confidence", F.lit(0.0)))
    n = F.length(F.coalesce("content", F.lit("")))
    return docs.agg(F.count("*").alias("docs"), F.round(F.avg(conf), 6).alias("avg_confidence"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.round(F.avg(n), 6).alias("avg_length"))


def top_domains(docs: DataFrame, k: int = 10, domain: str = "domain", seq: str = "doc_idx") -> DataFrame:
    """(domain, docs): the ``k`` most frequent domains, ties by first document; null counts as ''."""
    g = docs.groupBy(F.coalesce(domain, F.lit("")).alias("domain")).agg(F.count("*").alias("docs"), F.min(seq).alias("first"))
    return g.orderBy(F.desc("docs"), "first").limit(k).select("domain", "docs")


def validation(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, and the older ratio tp / actual positives under its old name."""
    t, p = F.coalesce(F.col(truth), F.lit(0)) == 1, F.coalesce(F.col(predicted), F.lit(0)) == 1
    c = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fn).alias("legacy_precision"))


def misclassified(rows: DataFrame, truth: str, predicted: str, order: str, k: int = 5) -> DataFrame:
    """The first ``k`` rows whose prediction is wrong, with the direction; nulls count as 0."""
    t, p = F.coalesce(F.col(truth), F.lit(0)), F.coalesce(F.col(predicted), F.lit(0))
    return rows.filter(t != p).withColumn("direction", F.when(t == 1, "missed personal").otherwise("false personal")).orderBy(order).limit(k)


def sample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same for the same seed: the smallest hashes of the key."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def overlap(a: DataFrame, b: DataFrame, key: str = "url") -> DataFrame:
    """One row: rows of both lists, common ones, and their share of the longer list in per cent."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    both = x.withColumn("a", F.lit(1)).join(y.withColumn("b", F.lit(1)), key, "full")
    c = both.agg(F.count("a").alias("first"), F.count("b").alias("second"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"))
    longer = F.greatest("first", "second")
    share = _pct(F.col("common"), longer)
    return c.select("*", share.alias("overlap_pct"), F.when(share == 100, "identical").when(share >= 50, "similar").otherwise("different").alias("verdict"))
