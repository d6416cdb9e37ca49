"""Row choice at scale: first rows per key, ranks and moving windows without a single task, pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.plans.runtime import materialize


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``. Aggregates before the shuffle, so a key with many copies costs one row per task."""
    cols = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in cols]), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*[F.col(f"`{c}`") if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Rows numbered from 1 by ``order``: range partitions are numbered on their own and shifted by the rows before them."""
    parts = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "rank")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))  # one row per partition
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_rn", within).join(F.broadcast(before), "_p").withColumn(name, F.col("_rn") + F.col("_before")).drop("_p", "_rn", "_before")


def moving_average(df: DataFrame, value: str, order: list[str], width: int, block: int = 100_000) -> DataFrame:
    """Average of ``value`` over the last ``width`` rows by ``order``, for every row.

    Ranked rows are cut into blocks that also get the ``width - 1`` rows before them, so blocks are independent.
    """
    ranked = global_rank(df, order, "_rank")
    own = F.floor((F.col("_rank") - 1) / block)
    last = F.floor((F.col("_rank") + width - 2) / block)
    spread = ranked.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, last)))
    w = Window.partitionBy("_block").orderBy("_rank").rowsBetween(-(width - 1), 0)
    return spread.withColumn("moving_average", F.avg(value).over(w)).filter("_block = _own").drop("_rank", "_own", "_block")


def quantiles(df: DataFrame, value: str, at: dict[str, float]) -> DataFrame:
    """One row with the interpolated quantiles of ``value`` (no nulls), exact: values are counted, and the counts ranked over range partitions."""
    counted = df.groupBy(value).agg(F.count("*").alias("_c")).repartitionByRange(value).withColumn("_p", F.spark_partition_id())
    counted = materialize(counted, "quantiles")
    parts = counted.groupBy("_p").agg(F.sum("_c").alias("_n"))  # one row per partition
    before = parts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    upto = F.sum("_c").over(Window.partitionBy("_p").orderBy(value))
    ranked = counted.join(F.broadcast(before), "_p").withColumn("_hi", upto + F.col("_before")).withColumn("_lo", F.col("_hi") - F.col("_c"))
    total = ranked.agg(F.sum("_c").alias("_t"))
    r = ranked.crossJoin(F.broadcast(total))  # one row

    def pick(p: float) -> Column:
        pos = (F.col("_t") - 1) * p

        def nth(k: Column) -> Column:
            return F.max(F.when((F.col("_lo") <= k) & (k < F.col("_hi")), F.col(value)))

        lo, hi, part = nth(F.floor(pos)), nth(F.ceil(pos)), F.max(pos - F.floor(pos))
        return lo + (hi - lo) * part

    return r.agg(*[pick(p).alias(n) for n, p in at.items()])


def page_of(df: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    """Page ``page`` (from 1) of ``limit`` rows; the rows up to its end are taken by a top-k, not by a full sort."""
    if limit < 1 or page < 1:
        raise ValueError("limit and page must be at least 1")
    top = df.orderBy(*order).limit(page * limit)
    return top.orderBy(*order).offset((page - 1) * limit) if page > 1 else top
