"""Event tables as streams: rates by window with late events, and a running quality check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def follow(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Rows of the Parquet files that come into ``folder`` while a recording is converted."""
    return spark.readStream.schema(schema).parquet(folder)


def event_rates(rows: DataFrame, time: str, by: list[str], window: str = "10 seconds", slide: str | None = None, late: str | None = "30 seconds") -> DataFrame:
    """Events a window; windows close once the latest time is ``late`` beyond them, and later rows for them are left out.
    None keeps the watermark that ``rows`` have already."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    rows = rows.withWatermark(time, late) if late else rows
    found = rows.groupBy(span.alias("w"), *by).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def first_of_each(rows: DataFrame, time: str, keys: list[str], late: str = "30 seconds") -> DataFrame:
    """Rows without repeats of ``keys``, as when a page is read twice; keys are forgotten after ``late``."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
