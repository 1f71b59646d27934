"""Listens as a stream (an extension): daily counts with a watermark, and pairs as they first appear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.sources.views import padded


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events in a folder as a stream of listens."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.select("user_id", padded(F.get_json_object("props", "$.k"), 3).alias("track_id"), F.col("ts").alias("timestamp"))


def daily_listens(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Listens per track and day; a listen later than ``late`` behind the latest seen is dropped."""
    day = F.window("timestamp", "1 day")
    return stream.withWatermark("timestamp", late).groupBy(day, "track_id").agg(F.count(F.lit(1)).alias("listens")).select(F.col("window.start").alias("day"), "track_id", "listens")


def first_plays(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each pair once, when it is first seen within the watermark."""
    return stream.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["user_id", "track_id"])
