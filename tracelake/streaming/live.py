"""Landed events as a stream: an extension, not a feature of batch imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..sources.ingest import RAW, mapped


def landed_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RAW).parquet(folder)


def once(raw: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each event (file and offset) once, as long as its copies come within the delay."""
    # Watermarks need times with a zone; captures are in UTC, as the session is.
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["file_name", "file_offset"])


def durations(raw: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts and durations by window and class of event."""
    rows = mapped(raw).where(F.col("event_class") != "Unknown").withColumn("captured_at", F.col("captured_at").cast("timestamp")).withWatermark("captured_at", delay)
    return rows.groupBy(F.window("captured_at", window).alias("w"), "event_class").agg(F.count("*").alias("cnt"), F.sum("duration_us").alias("total_us")).select(F.col("w.start").alias("start"), "event_class", "cnt", "total_us")


def parameters(raw: DataFrame, redaction: str = "masked") -> DataFrame:
    rows = mapped(raw).select("captured_at", F.explode(fields.parameters(F.col("sql_text_raw"), F.col("event_class"))).alias("p"))
    return rows.select("captured_at", "p.name", fields.redacted(redaction, F.col("p.name"), F.col("p.value")).alias("r")).select("captured_at", "name", "r.*")
