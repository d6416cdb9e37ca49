"""Search metrics as a stream."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.plans.runtime import scratch_path


def hourly(log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(hour, searches, failed, total_ms) of a stream or table with searched_at, success and search_time_ms.

    Events later than the watermark are dropped; rows without a time are left out.
    """
    timed = log.filter("searched_at is not null").withColumn("searched_at", F.col("searched_at").cast("timestamp")).withWatermark("searched_at", delay)
    g = timed.groupBy(F.window("searched_at", "1 hour").alias("w")).agg(
        F.count("*").alias("searches"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failed"), F.round(F.sum("search_time_ms"), 3).alias("total_ms")
    )
    return g.select(F.col("w.start").alias("hour"), "searches", "failed", "total_ms")


def hourly_metrics(spark: SparkSession, source: str, delay: str = "10 minutes") -> DataFrame:
    """Run :func:`hourly` over what ``source`` holds now and return the hours closed by the watermark.

    ``source`` is a folder of parquet files that grows, or one file. State and output are in the shared folder, so a restart goes on where it was.
    """
    schema = spark.read.parquet(source).schema
    folder, options = source, {}
    if os.path.isfile(source):
        folder, options = os.path.dirname(source), {"pathGlobFilter": os.path.basename(source)}
    out, state = scratch_path(spark, "hourly"), scratch_path(spark, "hourly-state")
    stream = spark.readStream.schema(schema).options(**options).parquet(folder)
    q = hourly(stream, delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("hour timestamp, searches long, failed long, total_ms double").parquet(out)
