"""The tables behind the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.functions import parse
from planeweave.operators import events, timeline

#: Events of a line beyond which a rate is drawn instead of a mark for each, and the bins of the rate.
RASTER_MOST, RATE_BINS = 5000, 600


def frame_interval_series(frames: DataFrame) -> DataFrame:
    """t and interval_ms, at the later frame, of the finite times of the first channel."""
    least = frames.agg(F.min("channel").alias("_c"))
    rows = frames.crossJoin(F.broadcast(least)).where((F.col("channel") == F.col("_c")) & parse.is_finite(F.col("frame_timestamp_s")))  # one row
    found = timeline.bridged_intervals(rows.select("page_index", "frame_timestamp_s"), "page_index", "frame_timestamp_s")
    return found.join(rows.select("page_index", "frame_timestamp_s"), "page_index").where("interval IS NOT NULL").select(F.col("frame_timestamp_s").alias("t"), (F.col("interval") * 1000).alias("interval_ms"))


def clip_window(series: DataFrame, value: str = "interval_ms") -> DataFrame:
    """low and high of what is shown: the outer percentiles with their span, at least 2 % of the median, on either side."""
    p = series.agg(F.percentile(value, 0.005).alias("lo"), F.percentile(value, 0.995).alias("hi"), F.median(value).alias("m"))
    by = F.greatest(F.col("hi") - F.col("lo"), 0.02 * F.col("m"), F.lit(1e-6))
    return p.select((F.col("lo") - by).alias("low"), (F.col("hi") + by).alias("high"), F.col("m").alias("median"))


def raster_or_rate(aux: DataFrame, line: int, low: float, high: float) -> tuple[str, DataFrame]:
    """("raster", times) of a line, or ("rate", t and events a second) if it has many events."""
    times = events.valid_events(aux.where(F.col("aux_line") == line)).select("timestamp_s")
    if times.count() <= RASTER_MOST or not high > low:
        return "raster", times
    width = (high - low) / RATE_BINS
    bins = events.histogram(times, F.col("timestamp_s"), F.lit(low), F.lit(high), RATE_BINS)
    return "rate", bins.select((F.lit(low) + (F.col("bin") + 0.5) * width).alias("t"), (F.col("n") / width).alias("rate"))


def cumulative(aux: DataFrame) -> DataFrame:
    """aux_line, timestamp_s, n: the count of events up to each."""
    return timeline.running_count(events.valid_events(aux), ["aux_line"], ["timestamp_s", "page_index", "event_pos"]).select("aux_line", "timestamp_s", "n")
