"""Quality control: a function for each finding, on the tables of one or many recordings.

Each returns the group keys with level, code, message, n and details, and no row where there is nothing to say. A recording's
report is their union, in the order of ``CODES``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planeweave.functions import parse
from planeweave.operators import pixels, sweep, timeline

#: Codes and the order in which a report lists them. Fixed values of the reports.
CODES = (
    "read_warning", "geometry_fallback", "no_pages", "frame_number_missing", "frame_number_repeats", "frame_number_gaps",
    "timestamp_unreadable", "timestamp_negative", "timestamp_not_monotonic", "timestamp_jitter", "volume_interval_nonpositive",
    "volume_rate_mismatch", "volume_interval_jitter", "partial_volume", "truncated_page_header", "page_header_drift",
    "unknown_page_keys", "recovered_pages", "no_end_of_acquisition", "dc_over_voltage", "aux_negative_timestamp",
    "aux_not_monotonic", "i2c_invalid_timestamp",
)
#: Relative deviations that are an error, and a warning.
ERROR_AT, WARN_AT = 0.10, 0.01


def finding(groups: DataFrame, by: Sequence[str], level: Column | str, code: str, n: Column | str, message: Column | str, details: dict[str, Column] | None = None) -> DataFrame:
    """``groups`` as findings."""
    as_map = F.create_map(*(x for k, v in (details or {}).items() for x in (F.lit(k), v.cast("string")))) if details else F.create_map().cast("map<string,string>")
    level = F.lit(level) if isinstance(level, str) else level
    count = F.col(n) if isinstance(n, str) else n
    text = F.lit(message) if isinstance(message, str) else message
    return groups.select(*by, level.alias("level"), F.lit(code).alias("code"), text.alias("message"), count.cast("bigint").alias("n"), as_map.alias("details"))


def _count(df: DataFrame, by: Sequence[str], bad: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(bad).alias("n")).where("n > 0")


def _said(text: str) -> Column:
    return F.format_string(f"%d {text}", F.col("n"))


def first_pages(df: DataFrame, by: Sequence[str], page: str, k: int = 10) -> DataFrame:
    """The ``k`` first pages of each group: ranks are cut in each task, so no group is gathered."""
    top = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(page))).where(F.col("_r") <= k)
    return top.groupBy(*by).agg(F.sort_array(F.collect_list(page)).alias("first_pages"))


def frame_number_missing(df: DataFrame, by: Sequence[str], number: str) -> DataFrame:
    return finding(_count(df, by, F.col(number) < 0), by, "warning", "frame_number_missing", "n", _said("pages have no frame number"))


def frame_number_repeats(df: DataFrame, by: Sequence[str], number: str, n_channels: int = 1) -> DataFrame:
    odd = timeline.repeats(df.where(F.col(number) >= 0), [*by, number], n_channels).groupBy(*by).agg(F.count("*").alias("n"))
    return finding(odd, by, "warning", "frame_number_repeats", "n", _said(f"frame numbers do not come {n_channels} times"))


def frame_number_gaps(df: DataFrame, by: Sequence[str], number: str) -> DataFrame:
    known = df.where(F.col(number) >= 0).select(*by, number).distinct()
    holes = timeline.ordered_steps(known, by, number, number, "d").where("d > 1")
    groups = holes.groupBy(*by).agg(F.count("*").alias("gaps"), F.sum(F.col("d") - 1).alias("n"))
    return finding(groups, by, "error", "frame_number_gaps", "n", _said("frame numbers are missing"), {"n_gaps": F.col("gaps")})


def timestamp_unreadable(df: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    return finding(_count(df, by, ~parse.is_finite(F.col(time).cast("double"))), by, "warning", "timestamp_unreadable", "n", _said("frame times cannot be read"))


def timestamp_negative(df: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    return finding(_count(df, by, parse.is_finite(F.col(time).cast("double")) & (F.col(time) < 0)), by, "error", "timestamp_negative", "n", _said("frame times are negative"))


def _steps(df: DataFrame, by: Sequence[str], order: str, time: str) -> DataFrame:
    rows = df.where(parse.is_finite(F.col(time).cast("double")))
    return timeline.ordered_steps(rows.select(*by, order, time), by, order, time).select(*by, "interval").where("interval IS NOT NULL")


def timestamp_not_monotonic(df: DataFrame, by: Sequence[str], order: str, time: str) -> DataFrame:
    return finding(_count(_steps(df, by, order, time), by, F.col("interval") <= 0), by, "error", "timestamp_not_monotonic", "n", _said("frame times do not rise"))


def _jitter(steps: DataFrame, by: Sequence[str], code: str, what: str) -> DataFrame:
    rows = pixels.jitter(steps, by, "interval").where((F.col("median_interval") > 0) & (F.col("max_deviation") >= WARN_AT))
    level = F.when(F.col("max_deviation") >= ERROR_AT, "error").otherwise("warning")
    text = F.format_string(f"{what} intervals deviate by up to %.2f %% from their median", F.col("max_deviation") * 100)
    return finding(rows, by, level, code, F.lit(1), text, {"rms_jitter": F.col("rms_jitter"), "max_deviation": F.col("max_deviation")})


def timestamp_jitter(df: DataFrame, by: Sequence[str], order: str, time: str) -> DataFrame:
    return _jitter(_steps(df, by, order, time), by, "timestamp_jitter", "frame")


def volume_steps(df: DataFrame, by: Sequence[str], page: str, time: str, pages_per_volume: int) -> DataFrame:
    """Intervals between the first pages of complete volumes, counted through all files."""
    n = df.groupBy(*by).agg(F.expr(f"count(*) div {pages_per_volume} * {pages_per_volume}").alias("_n"))
    starts = df.where(F.col(page) % pages_per_volume == 0).join(n, list(by)).where(F.col(page) < F.col("_n"))
    return _steps(starts, by, page, time)


def volume_timing(df: DataFrame, by: Sequence[str], page: str, time: str, pages_per_volume: int, rate_hz: float | None = None) -> DataFrame:
    """volume_interval_nonpositive, or else volume_rate_mismatch and volume_interval_jitter."""
    steps = volume_steps(df, by, page, time, pages_per_volume)
    middle = steps.groupBy(*by).agg(F.median("interval").alias("m"))
    out = finding(middle.where("m <= 0"), by, "error", "volume_interval_nonpositive", F.lit(1), "the median volume interval is not positive")
    good = middle.where("m > 0")
    if rate_hz:
        off = F.abs(1 / F.col("m") / rate_hz - 1)
        out = out.unionByName(finding(good.where(off > WARN_AT), by, "warning", "volume_rate_mismatch", F.lit(1), F.format_string("the volume rate is %.4f Hz, not the header's", 1 / F.col("m")), {"deviation": off}))
    return out.unionByName(_jitter(steps.join(good.select(*by), list(by), "left_semi"), by, "volume_interval_jitter", "volume"))


def partial_volume(df: DataFrame, by: Sequence[str], pages_per_volume: int) -> DataFrame:
    rows = df.groupBy(*by).agg((F.count("*") % pages_per_volume).alias("n")).where(F.col("n") > 0) if pages_per_volume > 1 else df.groupBy(*by).agg(F.lit(0).alias("n")).where("n > 0")
    return finding(rows, by, "warning", "partial_volume", "n", _said("pages are left after the last whole volume"))


def truncated_page_header(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = sweep.truncated(counts, by)
    groups = rows.groupBy(*by).agg(F.sum("n_pages").alias("n"), F.max(F.size("lost")).alias("lost"), F.max(F.size("lost_events")).alias("events"), F.min("first_page").alias("first"))
    level = F.when(F.col("events") > 0, "error").otherwise("warning")
    return finding(groups, by, level, "truncated_page_header", "n", _said("page headers break off"), {"n_keys_lost": F.col("lost"), "first_page": F.col("first")})


def page_header_drift(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = [*by, "signature"]
    left = counts.join(sweep.truncated(counts, by).select(*keys), keys, "left_anti")
    groups = (left.groupBy(*by) if by else left.groupBy()).agg(F.count("*").alias("n")).where("n > 1")
    return finding(groups, by, "warning", "page_header_drift", "n", _said("different sets of page-header keys"))


def unknown_page_keys(unknown: DataFrame, by: Sequence[str]) -> DataFrame:
    groups = unknown.groupBy(*by).agg(F.count("*").alias("n")).where("n > 0")
    return finding(groups, by, "info", "unknown_page_keys", "n", _said("page-header keys are not known"))


def no_end_of_acquisition(df: DataFrame, by: Sequence[str], flag: str = "end_of_acquisition") -> DataFrame:
    rows = df.groupBy(*by).agg(F.count_if(F.col(flag) == 1).alias("n")).where("n = 0")
    return finding(rows, by, "info", "no_end_of_acquisition", "n", "no page is marked as the last one")


def dc_over_voltage(df: DataFrame, by: Sequence[str], flag: str = "dc_over_voltage") -> DataFrame:
    return finding(_count(df, by, F.col(flag) == 1), by, "warning", "dc_over_voltage", "n", _said("pages have an over-voltage"))


def aux_negative_timestamp(df: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    return finding(_count(df, by, F.col(time) < 0), by, "warning", "aux_negative_timestamp", "n", _said("trigger times are negative"))


def aux_not_monotonic(df: DataFrame, by: Sequence[str], order: str, time: str) -> DataFrame:
    rows = timeline.order_checks(df, by, order, time).where("any_falling").withColumnRenamed("n_falling", "n")
    return finding(rows, by, "warning", "aux_not_monotonic", "n", _said("trigger times fall in page order"))


def i2c_invalid_timestamp(df: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    return finding(_count(df, by, ~parse.is_valid_time(F.col(time))), by, "warning", "i2c_invalid_timestamp", "n", _said("packet times are not valid"))


def in_order(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Findings as a report lists them."""
    place = F.array_position(F.array(*map(F.lit, CODES)), F.col("code"))
    return found.orderBy(*by, place, "message")
