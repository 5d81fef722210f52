"""Streams of scored events: prevalence by window, first-seen samples, running score moments. Our own addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Files of events as a stream, a few files a step."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windows(stream: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, n_rows, n_errors, mean_value: tumbling windows; rows later than the watermark are dropped."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", size))
    out = w.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.avg("value").alias("mean_value"))
    return out.select(F.col("window.start").alias("window_start"), "n_rows", "n_errors", "mean_value")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    out = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n_rows"))
    return out.select("user_id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("finish"), "n_rows")


def first_seen(stream: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
