"""Filters, decoding and summaries of event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planeweave.functions import parse
from planeweave.operators import timeline


def valid_events(df: DataFrame, time: str = "timestamp_s") -> DataFrame:
    """Events whose time is finite and not negative."""
    return df.where(parse.is_valid_time(F.col(time)))


def intervals(df: DataFrame, by: Sequence[str], order: str | Sequence[str], time: str, name: str = "interval") -> DataFrame:
    """``df`` with the time since the row before, in each group; the first has none. Filter before, so that gaps are bridged."""
    order = [order] if isinstance(order, str) else list(order)
    return df.withColumn(name, F.col(time) - F.lag(time).over(Window.partitionBy(*by).orderBy(*order)))


def summarize(df: DataFrame, by: Sequence[str], time: str = "timestamp_s") -> DataFrame:
    """Counts, non-finite and negative ones, span, and the median, least and largest interval of the sorted finite times."""
    t = F.col(time)
    real = t.isNotNull() & parse.is_finite(t.cast("double"))
    rows = df.select(*by, F.when(real, t).alias("t"))
    steps = timeline.sorted_intervals(rows, by, "t", "d").groupBy(*by).agg(F.median("d").alias("median_interval"), F.min("d").alias("min_interval"), F.max("d").alias("max_interval"))
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("n_events"),
        F.count_if(F.col("t").isNull()).alias("n_nonfinite"),
        F.count_if(F.col("t") < 0).alias("n_negative"),
        F.min("t").alias("first_time"),
        F.max("t").alias("last_time"),
    )
    return counts.join(steps, list(by), "left")


def histogram(df: DataFrame, value: Column, low: Column, high: Column, bins: int, name: str = "bin") -> DataFrame:
    """Counts by bin of equal width from ``low`` to ``high``, the last closed; what lies outside is left out."""
    at = F.when(value == high, F.lit(bins - 1)).otherwise(F.floor((value - low) * bins / (high - low))).cast("int")
    return df.where((value >= low) & (value <= high)).groupBy(at.alias(name)).agg(F.count("*").alias("n"))


def payload_kinds(df: DataFrame, by: Sequence[str], kind: str = "payload_kind") -> DataFrame:
    """text, bytes or mixed, by group."""
    n, text = F.count("*"), F.count_if(F.col(kind) == "text")
    return df.groupBy(*by).agg(n.alias("n_packets"), F.when(text == n, "text").when(text == 0, "bytes").otherwise("mixed").alias("payload_kind"))


def payload_matrix(df: DataFrame, data: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``padded``: the bytes of ``data`` followed by zeros up to the longest in the group."""
    width = df.groupBy(*by).agg(F.max(F.size(data)).alias("_width")) if by else df.agg(F.max(F.size(data)).alias("_width"))
    rows = df.join(width, list(by)) if by else df.crossJoin(width)  # one row
    return rows.withColumn("padded", F.concat(F.col(data), F.array_repeat(F.lit(0).cast(df.schema[data].dataType.elementType), (F.col("_width") - F.size(data)).cast("int")))).drop("_width")


def decode_payloads(df: DataFrame, kind: str = "payload_kind", text: str = "text", data: str = "data") -> DataFrame:
    """``df`` with ``text`` and ``decoded`` of its payloads."""
    return df.withColumn("_t", parse.payload_text(F.col(kind), F.col(text), F.col(data))).withColumns({"text": F.col("_t.text"), "decoded": F.col("_t.decoded")}).drop("_t")


def key_values(df: DataFrame, kind: str, text: str, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """All or nothing in each group: rows with key and value, and a table of groups with why they were refused, if so."""
    pair = parse.key_value(F.col(text))
    rows = df.withColumn("_p", F.when(F.col(kind) == "text", pair))
    bad_kind, bad_text = F.count_if(F.col(kind) != "text"), F.count_if((F.col(kind) == "text") & F.col("_p").isNull())
    why = F.when(bad_kind > 0, F.format_string("%d packets are not text", bad_kind)).when(bad_text > 0, F.format_string("%d packets are not key_number", bad_text))
    groups = rows.groupBy(*by).agg(F.count("*").alias("n_packets"), why.alias("reason")) if by else rows.agg(F.count("*").alias("n_packets"), F.when(F.count("*") == 0, "there are no packets").otherwise(why).alias("reason"))
    good = groups.where("reason IS NULL").drop("reason", "n_packets")
    kept = rows.join(good, list(by), "left_semi") if by else rows.crossJoin(good.select(F.lit(1).alias("_one")) if good.columns else groups.where("reason IS NULL").select(F.lit(1).alias("_one"))).drop("_one")
    return kept.withColumns({"key": F.col("_p.key"), "value": F.col("_p.value")}).drop("_p"), groups


def missing_lines(df: DataFrame, by: Sequence[str], line: str, lines: DataFrame) -> DataFrame:
    """For each group, the ``lines`` (a small table of one column) on which it has no event."""
    return df.select(*by).distinct().crossJoin(F.broadcast(lines.select(line))).join(df.select(*by, line).distinct(), [*by, line], "left_anti")  # a few lines
