"""Projections of pixel stacks, profiles, contrast and outliers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.functions import parse

#: Parts in which the images of a group's tasks are summed before the last step.
FAN = 32
METHODS = {"mean": F.avg, "max": F.max, "std": F.stddev_pop}


def project(df: DataFrame, by: Sequence[str], value: str, methods: Sequence[str], repeat: Sequence[str] = (), average_repeats: bool = False) -> DataFrame:
    """One row a group with a column for each method; with ``average_repeats`` the mean over ``repeat`` groups comes first.

    All methods come from one pass: partial sums before the shuffle, which is on ``by``.
    """
    rows = df.select(*by, *repeat, F.col(value).alias("_v"))
    if average_repeats:
        rows = rows.groupBy(*by, *repeat).agg(F.avg("_v").alias("_v"))
    return rows.groupBy(*by).agg(*(METHODS[m]("_v").alias(m) for m in methods))


def exploded(df: DataFrame, keys: Sequence[str], pixels: str) -> DataFrame:
    """A row for each pixel: keys, pos, value."""
    return df.select(*keys, F.posexplode(pixels).alias("pos", "value"))


class Sums:
    """Count, mean, squares around the mean and maxima of images; what no method needs is left empty."""

    def __init__(self, methods: Sequence[str]):
        self.squares, self.maxima = "std" in methods, "max" in methods
        self.n, self.mean, self.square, self.most = 0, None, np.zeros(0), np.zeros(0)

    def add(self, n: int, mean: np.ndarray, square: np.ndarray, most: np.ndarray) -> None:
        """The sums of ``n`` more images, by Chan's update."""
        if self.mean is None:
            self.mean = np.array(mean, np.float64)
            self.square = np.array(square, np.float64) if self.squares else self.square
            self.most = np.array(most, np.float64) if self.maxima else self.most
        else:
            delta, total = mean - self.mean, self.n + n
            self.mean += delta * (n / total)
            if self.squares:
                self.square += square + delta * delta * (self.n * n / total)
            if self.maxima:
                np.maximum(self.most, most, out=self.most)
        self.n += n

    def image(self, image: np.ndarray) -> None:
        self.add(1, image, np.zeros_like(image) if self.squares else self.square, image)

    def result(self, method: str) -> np.ndarray:
        return self.mean if method == "mean" else self.most if method == "max" else np.sqrt(self.square / self.n)


IMAGES = "n bigint, mean array<double>, square array<double>, most array<double>"


def project_images(df: DataFrame, by: Sequence[str], pixels: str, methods: Sequence[str], average: str | None = None, wide: bool = False) -> DataFrame:
    """A row a group with an array for each method; for images of any size.

    The images of a task are summed by group before the shuffle, and a group's sums are merged as they come, sorted, so a task
    holds one group at a time. With ``wide``, for groups that lie in many tasks, ``FAN`` parts of a group are merged
    first. With ``average``, the pages that share its value are averaged first, in single precision, as repeats of a plane.
    """
    keys = [*by, *([average] if average else [])]
    needed = ["mean"] if average else list(methods)
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*keys).schema.fields)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, Sums] = {}
            names = list(zip(*(batch.column(k).to_pylist() for k in range(len(keys))), strict=True)) if keys else [()] * batch.num_rows
            for i, key in enumerate(names):
                image = batch.column(len(keys))[i].values.to_numpy(zero_copy_only=False)
                groups.setdefault(key, Sums(needed)).image(image)
            yield _rows(list(groups.items()), keys, batch.schema)

    def merge(batches: Iterator[pa.RecordBatch], names: list[str], tell) -> Iterator[pa.RecordBatch]:
        """Sorted sums become one row a group."""
        last, sums = None, None
        for batch in batches:
            done = []
            found = list(zip(*(batch.column(k).to_pylist() for k in range(len(names))), strict=True)) if names else [()] * batch.num_rows
            n, rest = batch.column(len(names)).to_pylist(), [batch.column(len(names) + k) for k in (1, 2, 3)]
            for i, key in enumerate(found):
                if key != last or sums is None:
                    if sums is not None:
                        done.append((last, sums))
                    last, sums = key, Sums(needed)
                sums.add(n[i], *(c[i].values.to_numpy(zero_copy_only=False) for c in rest))
            if done:
                yield tell(done, batch.schema)
            schema = batch.schema
        if sums is not None:
            yield tell([(last, sums)], schema)

    def dealt(rows: DataFrame, names: list[str]) -> DataFrame:
        return rows.repartition(*names).sortWithinPartitions(*names) if names else rows.repartition(1)

    sums = df.select(*keys, F.col(pixels).cast("array<double>").alias("_p")).mapInArrow(partial, f"{kinds}{IMAGES}")
    if wide:
        part = [*keys, "_part"]
        sums = sums.select(*keys, F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("_part"), "n", "mean", "square", "most")
        sums = dealt(sums, part).mapInArrow(lambda it: merge(it, part, lambda done, schema: _rows(done, part, schema)), f"{kinds}_part int, {IMAGES}").drop("_part")
    if average:
        single = lambda done, schema: pa.RecordBatch.from_arrays([*_keys(done, keys, schema), pa.array([s.mean.astype(np.float32).astype(np.float64) for _, s in done], pa.list_(pa.float64()))], [*keys, "_p"])
        return project_images(dealt(sums, keys).mapInArrow(lambda it: merge(it, keys, single), f"{kinds}_p array<double>"), by, "_p", methods)
    told = lambda done, schema: pa.RecordBatch.from_arrays([*_keys(done, keys, schema), *(pa.array([s.result(m) for _, s in done], pa.list_(pa.float64())) for m in methods)], [*keys, *methods])
    return dealt(sums, keys).mapInArrow(lambda it: merge(it, keys, told), kinds + ", ".join(f"{m} array<double>" for m in methods))


def _keys(done: list[tuple[tuple, Sums]], names: Sequence[str], schema: pa.Schema) -> list[pa.Array]:
    return [pa.array([k[i] for k, _ in done], schema.field(i).type) for i in range(len(names))]


def _rows(done: list[tuple[tuple, Sums]], names: Sequence[str], schema: pa.Schema) -> pa.RecordBatch:
    images = [pa.array([getattr(s, c) for _, s in done], pa.list_(pa.float64())) for c in ("mean", "square", "most")]
    return pa.RecordBatch.from_arrays([*_keys(done, names, schema), pa.array([s.n for _, s in done], pa.int64()), *images], [*names, "n", "mean", "square", "most"])


def band(height: int, share: float) -> tuple[int, int]:
    """Rows of the central band, by half-even rounding; at least one."""
    if not 0 < share <= 1:
        raise ValueError("the share of the band must lie in (0, 1]")
    low = round(height * (0.5 - share / 2))
    return low, max(low + 1, round(height * (0.5 + share / 2)))


def band_profile(df: DataFrame, keys: Sequence[str], pixels: str, height: int, width: int, share: float = 0.5) -> DataFrame:
    """keys, x, value: the least value of each column of the central band."""
    low, high = band(height, share)
    rows = exploded(df, keys, pixels).where((F.col("pos") >= low * width) & (F.col("pos") < high * width))
    return rows.groupBy(*keys, (F.col("pos") % width).cast("int").alias("x")).agg(F.min("value").alias("value"))


def stretch(value: Column, low: Column, high: Column) -> Column:
    """0 to 255 between two percentiles, cut toward zero."""
    top = F.when(high <= low, low + 1).otherwise(high)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (top - low)))
    return F.floor(share * 255).cast("int")


def keep_inliers(df: DataFrame, by: Sequence[str], value: str, limit: float = 3.5) -> DataFrame:
    """Rows whose modified z-score stays within ``limit``; a deviation of zero keeps all."""
    middle = df.groupBy(*by).agg(F.median(value).alias("_m"))
    rows = df.join(middle, list(by))
    spread = rows.groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("_m"))).alias("_mad"))
    rows = rows.join(spread, list(by))
    return rows.where((F.col("_mad") == 0) | (F.abs(0.6745 * (F.col(value) - F.col("_m")) / F.col("_mad")) <= limit)).drop("_m", "_mad")


def jitter(df: DataFrame, by: Sequence[str], interval: str) -> DataFrame:
    """Median interval, and the root mean square and largest relative deviation from it."""
    rows = df.where(F.col(interval).isNotNull())
    middle = rows.groupBy(*by).agg(F.median(interval).alias("median_interval"))
    off = F.abs(F.col(interval) / F.col("median_interval") - 1)
    return rows.join(middle, list(by)).groupBy(*by, "median_interval").agg(F.sqrt(F.avg(off * off)).alias("rms_jitter"), F.max(off).alias("max_deviation"))


cast_pixels = parse.cast_pixels
