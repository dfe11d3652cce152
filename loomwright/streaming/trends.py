"""Streaming versions of the daily aggregates over event streams. An extension: watermarks bound the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators.aggregates import count_if

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of Parquet files of events."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_trend(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Per day: total and errors; a day's row is final once the watermark has passed it."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"))
    return days.agg(F.count(F.lit(1)).alias("total"), count_if(F.col("event_type") == "error").alias("errors")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "total", "errors")


def distinct_events(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events without repeats of an id that arrive within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
