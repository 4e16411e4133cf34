"""Batch operators that run unchanged on streams: windows with late data, first-seen records, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream_parquet(spark: SparkSession, folder: str, schema: StructType, pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def tumbling(events: DataFrame, ts: str, width: str, by: str, value: str, watermark: str | None = None) -> DataFrame:
    """(window_start, by, n, total) per window of event time. On a stream the watermark bounds the state; rows later
    than it are dropped by Spark. On a batch it has no effect."""
    src = events.withWatermark(ts, watermark) if watermark and events.isStreaming else events
    return src.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sliding(events: DataFrame, ts: str, width: str, slide: str, by: str, watermark: str | None = None) -> DataFrame:
    src = events.withWatermark(ts, watermark) if watermark and events.isStreaming else events
    return src.groupBy(F.window(ts, width, slide).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def sessions(events: DataFrame, ts: str, gap: str, user: str, watermark: str | None = None) -> DataFrame:
    """(user, session_start, session_end, n)."""
    src = events.withWatermark(ts, watermark) if watermark and events.isStreaming else events
    return src.groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def first_seen(events: DataFrame, key: str, ts: str, within: str | None = None) -> DataFrame:
    """One row per key. On a stream duplicates are remembered within the watermark; on a batch the earliest row wins."""
    if events.isStreaming:
        return events.withWatermark(ts, within or "1 day").dropDuplicatesWithinWatermark([key])
    rest = [c for c in events.columns if c not in (key, ts)]
    best = events.groupBy(key).agg(F.min(F.struct(ts, *rest)).alias("b"))
    return best.select(*(F.col(key) if c == key else F.col(f"b.{c}").alias(c) for c in events.columns))
