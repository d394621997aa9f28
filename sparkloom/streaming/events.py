"""The measurement log as a stream of files: windowed statistics and spans with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema: str = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING", max_files: int = 16) -> DataFrame:
    """A folder of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def windowed_stats(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and largest value by event and window; rows later than `late` are dropped, state with them."""
    return (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("largest"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "mean", "largest")
    )


def spans(log: DataFrame, start: str, end: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Each start with the ends of its user inside `within`: a stream-stream join bounded by time, so state is bounded too."""
    a = log.where(F.col("event_type") == start).withWatermark("ts", late).select(F.col("user_id").alias("u"), F.col("ts").alias("t0"), F.col("event_id").alias("start_id"))
    b = log.where(F.col("event_type") == end).withWatermark("ts", late).select("user_id", F.col("ts").alias("t1"), F.col("event_id").alias("end_id"))
    joined = a.join(b, F.expr(f"u = user_id AND t1 >= t0 AND t1 <= t0 + interval {within}"))
    return joined.select("user_id", "start_id", "end_id", (F.unix_micros("t1") - F.unix_micros("t0")).alias("micros"))
