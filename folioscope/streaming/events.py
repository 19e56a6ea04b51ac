"""Streaming counterparts: the same expressions over readStream, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import corpus as C


def read(spark: SparkSession, folder: str, like: DataFrame, files: int = 16) -> DataFrame:
    """Parquet files of a folder as they come, with the schema of an existing table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _watermarked(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with a watermark, which needs timestamps of the session's zone; a table as it is."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def windowed(events: DataFrame, time: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of value by event type and time window; works on streams and tables alike."""
    rows = _watermarked(events, time, late)
    by = F.window(time, size, slide) if slide else F.window(time, size)
    out = rows.groupBy(by.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each user: runs of events no further apart than gap."""
    rows = _watermarked(events, time, late)
    out = rows.groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def token_counts(texts: DataFrame) -> DataFrame:
    """Running token counts of a stream of texts, for complete or update output."""
    return C.token_counts(C.tokenized(texts))
