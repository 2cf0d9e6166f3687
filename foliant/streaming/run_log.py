"""Metrics of run logs while they grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import values as V


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A growing folder of JSON lines."""
    return spark.readStream.schema(schema).json(path)


def stage_windows(stream: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events, failures and time by window and phase; rows later than `late` are left out. State is bounded by the windows still open."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, F.coalesce("phase", F.lit("unknown")).alias("phase")).agg(F.count("*").alias("events"), F.count(F.when(F.col("event_type").endswith("_error"), 1)).alias("failed"), F.sum(V.as_int("elapsed_ms")).alias("elapsed_ms")).select("window.start", "window.end", "phase", "events", "failed", "elapsed_ms")


def once_per_event(stream: DataFrame, key: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The stream without events that come again within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
