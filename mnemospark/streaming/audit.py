"""Counts of audit events by kind and window, from a folder that events are appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed(stream: DataFrame, at: str = "created_at", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Late events count until the watermark passes their window; state is one row for each kind and open window."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, window), "kind").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "kind", "n")
