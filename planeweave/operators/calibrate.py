"""Pixel to micron calibration: line pitch, the table by zoom, interpolation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.operators.pixels import band


def find_peaks(y: np.ndarray, distance: int = 1, prominence: float = 0.0) -> np.ndarray:
    """Local maxima (the middle of a plateau), at least ``distance`` apart, the higher ones first, then prominent ones."""
    found, i = [], 1
    while i < len(y) - 1:
        if y[i - 1] < y[i]:
            j = i
            while j + 1 < len(y) and y[j + 1] == y[i]:
                j += 1
            if j + 1 < len(y) and y[j + 1] < y[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    peaks = np.array(found, int)
    keep = np.ones(len(peaks), bool)
    for k in np.argsort(y[peaks], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(peaks - peaks[k]) < distance
            near[k] = False
            keep &= ~near
    peaks = peaks[keep]

    def prominent(p: int) -> bool:
        higher = np.flatnonzero(y > y[p])
        left, right = higher[higher < p], higher[higher > p]
        low = y[(left[-1] + 1 if len(left) else 0) : p + 1].min()
        high = y[p : (right[0] if len(right) else len(y))].min()
        return y[p] - max(low, high) >= prominence

    return peaks[[prominent(p) for p in peaks]] if len(peaks) else peaks


@dataclass
class Pitch:
    """What was measured on an image of lines along an axis."""

    pitch_px: float | None
    um_per_px: float | None
    cv: float | None
    n_peaks: int
    n_retained: int
    resolution_px: int
    ok: bool
    reason: str


def measure_pitch(image: np.ndarray, axis: str, pitch_um: float = 10.0, center: float = 0.5, min_peaks: int = 5, max_cv: float = 0.15) -> Pitch:
    """The distance of dark lines in the central band; a doubtful measurement is given with ``ok`` False and why."""
    image = np.asarray(image, float).T if axis == "y" else np.asarray(image, float)
    low, high = band(image.shape[0], center)
    profile = image[low:high].min(axis=0)
    width = image.shape[1]
    span = profile.max() - profile.min()
    if not span > 0:
        return Pitch(None, None, None, 0, 0, width, False, "no contrast")
    peaks = find_peaks(profile.max() - profile, 3, 0.15 * span)
    if len(peaks) < 2:
        return Pitch(None, None, None, len(peaks), 0, width, False, "fewer than two lines")
    gaps = np.diff(peaks).astype(float)
    middle = np.median(gaps)
    mad = np.median(np.abs(gaps - middle))
    kept = gaps if mad == 0 else gaps[np.abs(0.6745 * (gaps - middle) / mad) <= 3.5]
    kept = kept if len(kept) else gaps
    pitch = float(np.median(kept))
    cv = float(np.median(np.abs(kept - pitch)) / pitch)
    why = f"{len(peaks)} lines, {min_peaks} are needed" if len(peaks) < min_peaks else f"spacing varies by {cv:.3f}" if cv > max_cv else ""
    return Pitch(pitch, pitch_um / pitch, cv, len(peaks), len(kept), width, not why, why)


PITCH = "pitch_px double, um_per_px double, cv double, n_peaks int, n_retained int, resolution_px int, ok boolean, reason string"


def measure(images: DataFrame, keys: Sequence[str], pixels: str, height: str, width: str, axis: str, **how) -> DataFrame:
    """``measure_pitch`` of each image (a row): keys and the measurement."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in images.select(*keys).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keys)
            found = []
            for i in range(batch.num_rows):
                h, w, ax = (batch.column(n + 1 + k)[i].as_py() for k in range(3))
                found.append(measure_pitch(batch.column(n)[i].values.to_numpy(zero_copy_only=False).reshape(h, w), ax, **how))
            names = list(Pitch.__dataclass_fields__)
            types = dict(zip(names, (pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array([getattr(f, x) for f in found], types[x]) for x in names)], [*keys, *names])

    return images.select(*keys, F.col(pixels).cast("array<double>"), height, width, axis).mapInArrow(run, f"{kinds}, {PITCH}")


def calibration_table(df: DataFrame, zoom: str, axis: str, um_per_px: str, n_peaks: str, resolution: str) -> DataFrame:
    """By zoom and for x and y: mean microns a pixel and its inverse, rounded mean peaks, rounded mean of the distinct resolutions."""
    out = []
    for a in ("x", "y"):
        here = F.col(axis) == a
        um = F.avg(F.when(here & ~F.isnan(um_per_px), F.col(um_per_px)))
        out += [um.alias(f"px_to_micron_{a}"), (1 / um).alias(f"micron_to_px_{a}"), F.rint(F.avg(F.when(here, F.col(n_peaks)))).cast("int").alias(f"n_peaks_{a}"), F.rint(F.avg_distinct(F.when(here, F.col(resolution))) if hasattr(F, "avg_distinct") else F.expr(f"avg(DISTINCT CASE WHEN {axis} = '{a}' THEN {resolution} END)")).cast("int").alias(f"resolution_px_{a}")]
    order = [f"{c}_{a}" for c in ("px_to_micron", "micron_to_px", "resolution_px", "n_peaks") for a in ("x", "y")]
    return df.groupBy(zoom).agg(*out).select(F.col(zoom).alias("zoom"), *order)


def interpolate(targets: DataFrame, knots: DataFrame, target: str, zoom: str, value: str) -> DataFrame:
    """``targets`` with the value at ``target`` on the line between the knots around it; null outside their range.

    Knots are a calibration table, one row a zoom, so each becomes a segment by ``lead`` and the join is one on ranges.
    """
    from pyspark.sql import Window

    k = knots.where(F.col(value).isNotNull()).select(F.col(zoom).alias("_z0"), F.col(value).alias("_v0"))
    w = Window.partitionBy(F.lit(0)).orderBy("_z0")
    k = k.withColumns({"_z1": F.lead("_z0").over(w), "_v1": F.lead("_v0").over(w)})
    inside = (F.col(target) >= F.col("_z0")) & ((F.col(target) < F.col("_z1")) | (F.col("_z1").isNull() & (F.col(target) == F.col("_z0"))))
    at = F.when(F.col(target) == F.col("_z0"), F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(target) - F.col("_z0")) / (F.col("_z1") - F.col("_z0")))
    return targets.join(k, inside, "left").withColumn("value", at).drop("_z0", "_v0", "_z1", "_v1")


def rescale(um_per_px, measured_px, target_px):
    """Microns a pixel at another resolution of the same field."""
    return um_per_px * measured_px / target_px


def resolve_zoom(header_zoom, name_zoom, tolerance: float = 0.05):
    """struct<zoom, warning>: the header's zoom, else the name's; a warning if they differ or the header's is missing."""
    warning = F.when(header_zoom.isNull(), "no zoom in the header").when(F.abs(header_zoom - name_zoom) > tolerance, "header and name differ")
    return F.struct(F.coalesce(header_zoom, name_zoom).alias("zoom"), warning.alias("warning"))
