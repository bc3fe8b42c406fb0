"""Plays as a stream: windowed counts behind a watermark, and a play log without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_plays(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)


def windowed_plays(plays: DataFrame, time: str = "ts", key: str = "event_type", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(start, key, plays, mean) by event-time window; rows later than the watermark allows are left out."""
    seen = plays.withWatermark(time, late)
    out = seen.groupBy(F.window(time, window), F.col(key)).agg(F.count("*").alias("plays"), F.avg("value").alias("mean"))
    return out.select(F.col("window.start").alias("start"), key, "plays", "mean")


def distinct_plays(plays: DataFrame, time: str = "ts", key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return plays.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def append_to_history(plays: DataFrame, path: str, checkpoint: str):
    """A query that appends plays to the history table, exactly once through the sink's log."""
    return plays.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
