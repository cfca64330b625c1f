"""Ordered operators that do not sort a whole recording in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers in a bucket of ``gaps``.
BUCKET = 1 << 16


def dense_intervals(df: DataFrame, by: Sequence[str], key: str, time: str, name: str = "interval") -> DataFrame:
    """``df`` with the time since the row of the key before, where keys are dense: an equi-join, so one recording
    may be as long as it likes. The first row of each group has none."""
    before = df.select(*by, (F.col(key) + 1).alias(key), F.col(time).alias("_before"))
    return df.join(before, [*by, key], "left").withColumn(name, F.col(time) - F.col("_before")).drop("_before")


def gaps(df: DataFrame, number: str, bucket: int = BUCKET) -> DataFrame:
    """before, after, n_missing of every gap in the distinct numbers of ``df``.

    Gaps inside a bucket of numbers come from a window on the bucket; those between buckets from a window on the buckets'
    ends, which are fewer by the bucket's size.
    """
    known = df.where(F.col(number).isNotNull()).select(F.col(number).alias("n")).distinct().withColumn("b", F.floor(F.col("n") / bucket).cast("bigint"))
    inside = known.select(F.col("n").alias("before"), F.lead("n").over(Window.partitionBy("b").orderBy("n")).alias("after"))
    ends = known.groupBy("b").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    across = ends.select(F.col("high").alias("before"), F.lead("low").over(Window.partitionBy(F.lit(0)).orderBy("b")).alias("after"))
    return inside.unionByName(across).where("after - before > 1").withColumn("n_missing", F.col("after") - F.col("before") - 1)


def repeats(df: DataFrame, keys: Sequence[str], expected: Column | int = 1) -> DataFrame:
    """Keys that do not come as often as expected, with how often they do."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") != expected)


def order_checks(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """By group: rows that do not rise, rows that fall, and whether any falls. Rows without ``order`` are left out."""
    d = F.col("_d")
    rows = ordered_steps(df.select(*by, order, value), by, order, value, "_d")
    return rows.groupBy(*by).agg(F.count_if(d <= 0).alias("n_not_rising"), F.count_if(d < 0).alias("n_falling"), F.coalesce(F.bool_or(d < 0), F.lit(False)).alias("any_falling"))


def span(df: DataFrame, by: Sequence[str], time: str, name: str = "duration") -> DataFrame:
    """The time from the first to the last row; null for fewer than two."""
    return df.groupBy(*by).agg(F.when(F.count(time) >= 2, F.max(time) - F.min(time)).alias(name))


def bridged_intervals(df: DataFrame, key: str, time: str, name: str = "interval", block: int = BUCKET) -> DataFrame:
    """``df`` (key, time) with the time since the row before in key order, where keys have holes.

    Blocks of keys are windowed each for itself; a block's first row looks to the last row of the block before, of which there
    is one a block.
    """
    w = Window.partitionBy("_b").orderBy(key)
    rows = df.withColumn("_b", F.floor(F.col(key) / block).cast("bigint"))
    ends = rows.groupBy("_b").agg(F.max_by(time, key).alias("_last"))
    before = ends.select("_b", F.lag("_last").over(Window.partitionBy(F.lit(0)).orderBy("_b")).alias("_before"))
    inside = rows.withColumns({"_lag": F.lag(time).over(w), "_n": F.row_number().over(w)})
    at = F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_lag"))
    return inside.join(before, "_b").withColumn(name, F.col(time) - at).select(key, name)


def blocked(df: DataFrame, by: Sequence[str], key: str, size: int = BUCKET) -> DataFrame:
    """``df`` with ``_b``: blocks of the key's range, of about ``size`` rows each where rows are spread evenly.

    Windows on blocks, joined at their ends, replace one window on a whole group, however large that is. Equal keys
    share a block.
    """
    k = F.col(key).cast("double")
    known = df.where(F.col(key).isNotNull()).groupBy(*by).agg(F.min(k).alias("_lo"), F.max(k).alias("_hi"), F.count("*").alias("_n"))
    width = F.greatest((F.col("_hi") - F.col("_lo")) * size / F.col("_n"), F.lit(1e-9))
    return df.join(known, list(by)).withColumn("_b", F.floor((k - F.col("_lo")) / width).cast("bigint")).drop("_lo", "_hi", "_n")


def sorted_intervals(df: DataFrame, by: Sequence[str], time: str, name: str = "interval", size: int = BUCKET) -> DataFrame:
    """``df`` with the step from the time before, in time order, by groups of any size; the first of a group has none."""
    rows = blocked(df.where(F.col(time).isNotNull()), by, time, size)
    ends = rows.groupBy(*by, "_b").agg(F.max(time).alias("_last"))
    before = ends.select(*by, "_b", F.lag("_last").over(Window.partitionBy(*by).orderBy("_b")).alias("_before"))
    w = Window.partitionBy(*by, "_b").orderBy(time)
    inside = rows.withColumn("_lag", F.lag(time).over(w))
    return inside.join(before, [*by, "_b"]).withColumn(name, F.col(time) - F.coalesce("_lag", "_before")).drop("_lag", "_before", "_b")


def running_count(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "n", size: int = BUCKET) -> DataFrame:
    """1, 2, ... in order (whose first column is a number), by groups of any size."""
    rows = blocked(df, by, order[0], size)
    counts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*by, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order))
    return rows.withColumn("_place", place).join(before, [*by, "_b"]).withColumn(name, (F.col("_place") + F.col("_before")).cast("bigint")).drop("_place", "_before", "_b")


def ordered_steps(df: DataFrame, by: Sequence[str], order: str, value: str, name: str = "interval", size: int = BUCKET) -> DataFrame:
    """``df`` with the step of ``value`` from the row before in the order of the numbers ``order``, by groups of any size; the first of a
    group has none. Blocks of rows are windowed each for itself and look to the last row of the block before."""
    rows = blocked(df.where(F.col(order).isNotNull()), by, order, size)
    ends = rows.groupBy(*by, "_b").agg(F.max_by(F.struct(F.col(value)), F.col(order))[value].alias("_last"))
    before = ends.select(*by, "_b", F.lag("_last").over(Window.partitionBy(*by).orderBy("_b")).alias("_before"))
    w = Window.partitionBy(*by, "_b").orderBy(order)
    inside = rows.withColumns({"_lag": F.lag(value).over(w), "_n": F.row_number().over(w)})
    at = F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_lag"))
    return inside.join(before, [*by, "_b"]).withColumn(name, F.col(value) - at).drop("_lag", "_n", "_before", "_b")
