"""Extra: render jobs as a stream, counted by state in windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def job_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(EVENTS).parquet(folder)


def states_by_window(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Jobs by state and window; events later than the watermark are left out, repeated ones count once."""
    df = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return df.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")
