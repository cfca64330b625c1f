"""Split acquisitions: discovery of their files, page offsets, and the merge of their tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planeweave.functions import parse

#: Header keys that differ between the files of one acquisition. Fixed values of the file format.
PER_FILE_KEYS = ("SI.hScan2D.logFileCounter", "SI.loopAcqCounter", "SI.acqsPerLoop")


def page_offsets(files: DataFrame, by: Sequence[str], index: str, n_pages: str) -> DataFrame:
    """``files`` with page_start and page_stop in the acquisition: a running sum over its files, which are few."""
    w = Window.partitionBy(*by).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(n_pages).over(w), F.lit(0)).cast("bigint")
    return files.withColumn("page_start", start).withColumn("page_stop", F.col("page_start") + F.col(n_pages))


def locate(pages: DataFrame, offsets: DataFrame, by: Sequence[str], page: str) -> DataFrame:
    """``pages`` with their file and their page in it: a join on the acquisition with a range in it."""
    rows = pages.join(offsets, list(by)).where((F.col(page) >= F.col("page_start")) & (F.col(page) < F.col("page_stop")))
    return rows.withColumn("file_page", (F.col(page) - F.col("page_start")).cast("bigint"))


def merge(files: Sequence[DataFrame], page: str = "page_index") -> DataFrame:
    """One table of all files, in their order: pages are numbered on through the files.

    A file's page count is its highest page and one; it is an aggregate of a row, joined and never collected.
    """
    parts = [f.withColumn("file_index", F.lit(i).cast("smallint")) for i, f in enumerate(files)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    counts = rows.groupBy("file_index").agg((F.max(page) + 1).alias("_n"))
    # as many rows as there are files
    starts = counts.alias("a").join(counts.alias("b"), F.col("b.file_index") < F.col("a.file_index"), "left").groupBy(F.col("a.file_index").alias("file_index")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).cast("bigint").alias("_start"))
    return rows.join(starts, "file_index").withColumn(page, F.col(page) + F.col("_start")).drop("_start")


def boundaries(frames: DataFrame, by: Sequence[str], file: str, order: str, time: str) -> DataFrame:
    """When each file but an acquisition's first begins: the time of its first row, if that is finite."""
    starts = frames.groupBy(*by, file).agg(F.min_by(time, order).alias("time"))
    first = starts.groupBy(*by).agg(F.min(file).alias("_first"))
    return starts.join(first, list(by)).where((F.col(file) > F.col("_first")) & parse.is_finite(F.col("time").cast("double"))).drop("_first")


def siblings(files: DataFrame, path: str, header: str, ignored: Sequence[str] = PER_FILE_KEYS) -> DataFrame:
    """``files`` with base, acquisition, file_index and whether each belongs to the acquisition.

    Files of one base and acquisition are compared with the first of them by natural order, on their header maps
    without the keys that differ from file to file.
    """
    kept = F.map_filter(F.col(header), lambda k, _: ~k.isin(*ignored))
    mark = F.xxhash64(F.array_sort(F.map_entries(kept)))
    rows = files.withColumn("_p", parse.filename_parts(F.col(path))).withColumns({"base": F.col("_p.base"), "acquisition": F.col("_p.acquisition"), "file_index": F.col("_p.file_index"), "_mark": mark, "_key": parse.natural_key(F.col(path))}).drop("_p")
    rows = rows.where(F.col("acquisition").isNotNull() & F.col("file_index").isNotNull())
    first = rows.groupBy("base", "acquisition").agg(F.min_by("_mark", "_key").alias("_first"))
    return rows.join(first, ["base", "acquisition"]).withColumn("belongs", F.col("_mark") == F.col("_first")).drop("_mark", "_first", "_key")


def nested_paths(df: DataFrame, key: str, sep: str = ".") -> DataFrame:
    """``df`` with ``path``: its dotted key, and ``_value`` below it where another key goes on from it."""
    parts = F.split(F.col(key), f"\\{sep}")
    prefixes = df.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, F.lit(1), n), sep)))).alias("_prefix")).where("_prefix IS NOT NULL").distinct()
    rows = df.join(prefixes, F.col(key) == F.col("_prefix"), "left")
    return rows.withColumn("path", F.when(F.col("_prefix").isNotNull(), F.concat(F.col(key), F.lit(f"{sep}_value"))).otherwise(F.col(key))).drop("_prefix")


def overridden(lines: Column, overrides: dict[str, str]) -> Column:
    """``key = value`` lines with the values of ``overrides`` for the keys that are there; no key is added."""
    known = F.create_map(*(x for k, v in overrides.items() for x in (F.lit(k), F.lit(v))))
    key = lambda x: parse.strip(F.substring_index(x, "=", 1))
    has = lambda x: F.locate("=", x) > 0
    return F.transform(lines, lambda x: F.when(has(x) & F.try_element_at(known, key(x)).isNotNull(), F.concat(key(x), F.lit(" = "), F.try_element_at(known, key(x)))).otherwise(x))


def plan_layout(headers: DataFrame, enabled: str, slices: str, kept: str, on_disk: str, per_slice: str, n_channels: str, n_pages: str) -> DataFrame:
    """``headers`` with the layout of each recording: volumetric, n_slices, frames_per_slice, kept_frames, on_disk_frames,
    pages_per_volume, flyback_frames, n_volumes and why a stack is taken as flat."""
    c, none = F.col, F.lit(0)
    missing = (F.coalesce(c(slices), none) == 0) | (F.coalesce(c(kept), none) == 0)
    # without a count with flyback there is no flyback, and without repeats a slice is taken once
    disk, fps = F.coalesce(F.nullif(c(on_disk), none), c(kept)), F.greatest(F.coalesce(c(per_slice), F.lit(1)), F.lit(1))
    warning = (
        F.when(missing, "missing")
        .when((c(kept) < 1) | (c(kept) > disk), "inconsistent frames")
        .when(c(slices) * fps != c(kept), "inconsistent slices")
        .when((c(n_pages) > 0) & (disk * c(n_channels) > c(n_pages)), "too long")
    )
    good = c(enabled) & warning.isNull()
    warning = F.when(c(enabled), warning).when((c(n_pages) > 0) & (c(n_channels) > c(n_pages)), "too long")
    one = lambda x: F.when(good, x).otherwise(1).cast("bigint")
    rows = headers.withColumns({"volumetric": good, "warning": warning, "n_slices": one(c(slices)), "frames_per_slice": one(fps), "kept_frames": one(c(kept)), "on_disk_frames": one(disk)})
    ppv = F.col("on_disk_frames") * c(n_channels)
    return rows.withColumns({"pages_per_volume": ppv.cast("bigint"), "flyback_frames": F.col("on_disk_frames") - F.col("kept_frames"), "n_volumes": F.expr(f"{n_pages} div (on_disk_frames * {n_channels})").cast("bigint")})
