"""Sinks of a recording: documents, tables, arrays, projections, calibrations and figures."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeweave.functions import layout, parse
from planeweave.operators import calibrate, events, pixels
from planeweave.plans.recording import Recording
from planeweave.schema import CALIBRATION
from planeweave.sources import header as headers
from planeweave.sources import tiff

TOOL = {"name": "planeweave", "version": "0.1.0"}


def jsonable(x: object) -> object:
    """``x`` for strict JSON: non-finite numbers by name, sets in order, bytes as text, times in ISO form."""
    if isinstance(x, dict):
        return {str(k): jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [jsonable(v) for v in x]
    if isinstance(x, (set, frozenset)):
        return [jsonable(v) for v in sorted(x, key=str)]
    if isinstance(x, np.ndarray):
        return jsonable(x.tolist())
    if isinstance(x, np.generic):
        return jsonable(x.item())
    if isinstance(x, float) and not math.isfinite(x):
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    if isinstance(x, bytes):
        return x.decode("utf-8", "replace")
    if isinstance(x, datetime):
        return x.isoformat()
    return str(x) if isinstance(x, Path) else x


def write_json(path: Path, x: object) -> None:
    path.write_text(json.dumps(jsonable(x), indent=2, allow_nan=False))


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def prepare(folder: str | Path, overwrite: bool = False) -> Path:
    """``folder``, made; an error if it holds something and may not be written over."""
    folder = Path(folder)
    if folder.exists() and any(folder.iterdir()) and not overwrite:
        raise FileExistsError(f"{folder} is not empty")
    folder.mkdir(parents=True, exist_ok=True)
    return folder


def build_metadata(rec: Recording, flat: bool = False, rois: bool = True) -> dict:
    frame_data = rec.header if flat else parse.nest_keys(rec.header)
    image = {"header_version": rec.get("VERSION_MAJOR"), "si_version": rec.summary()["si_version"], "framedata_layout": "flat" if flat else "nested", "FrameData": frame_data}
    if rois:
        image["RoiGroups"] = headers.roi_groups(str(rec.infos[0]["artist"]))
    files = [{"path": p, "filename": Path(p).name, "size_bytes": Path(p).stat().st_size, "modified": datetime.fromtimestamp(Path(p).stat().st_mtime, timezone.utc).isoformat()} for p in rec.paths]
    return {"tool": TOOL | {"created": now(), "nonfinite_encoding": "strings"}, "source": {"files": files, "merged_acquisition": len(files) > 1}, "summary": rec.summary(), "triggers": rec.trigger_summary(), "warnings": rec.warnings, "scanimage": image, "tiff_tags": rec.infos[0]["tags"]}


def to_npy(df: DataFrame, path: Path, order: Sequence[str]) -> None:
    """A table of one recording as a structured array without objects."""
    table = df.orderBy(*order).toPandas()
    kinds = []
    for name, kind in df.dtypes:
        wide = max([1, *(len(str(v)) for v in table[name])]) if kind == "string" else 0
        kinds.append((name, f"<U{wide}" if wide else {"bigint": "i8", "int": "i4", "smallint": "i2", "tinyint": "i1", "double": "f8", "boolean": "?"}[kind]))
    out = np.zeros(len(table), kinds)
    for name, _ in kinds:
        out[name] = table[name].to_numpy()
    np.save(path, out, allow_pickle=False)


def export_recording(rec: Recording, out: str | Path | None = None, *, metadata: bool = True, frames: bool = True, aux: bool = True, i2c: bool = True, decode_i2c: bool = False, parquet: bool = True, figure: bool = True, qc: bool = True, flat: bool = False, rois: bool = True, formats: Sequence[str] = ("svg",), overwrite: bool = False) -> dict:
    """All of a recording under ``out``/name; invalid events are left out, lines without events make no file."""
    folder = prepare(Path(out or Path(rec.paths[0]).parent) / rec.name, overwrite)
    files: list[str] = []
    good, packets = events.valid_events(rec.aux), rec.i2c.where("valid")
    counts: dict[str, int] = {}
    report = rec.report() if qc else None
    if metadata:
        write_json(folder / "metadata.json", build_metadata(rec, flat, rois))
        files.append("metadata.json")
    if frames:
        to_npy(rec.frames, folder / "frames.npy", ["page_index"])
        files.append("frames.npy")
        if parquet:
            rec.frames.write.mode("overwrite").parquet(str(folder / "frames.parquet"))
            files.append("frames.parquet")
    if aux:
        counts = {f"aux{r.aux_line}": r.n for r in good.groupBy("aux_line").agg(F.count("*").alias("n")).orderBy("aux_line").collect()}
        for line in counts:
            (folder / "aux_triggers").mkdir(exist_ok=True)
            to_npy(good.where(F.col("aux_line") == int(line[3:])).drop("aux_line"), folder / "aux_triggers" / f"{line}.npy", ["page_index", "event_pos"])
            files.append(f"aux_triggers/{line}.npy")
    n_packets = packets.count() if i2c else 0
    if n_packets:
        (folder / "i2c").mkdir(exist_ok=True)
        to_npy(packets.drop("packet"), folder / "i2c" / "packets.npy", ["page_index", "event_pos"])
        raw = packets.orderBy("page_index", "event_pos").select("timestamp_s", "packet.payload_kind", "packet.data", "packet.text", "packet.raw")
        write_json(folder / "i2c" / "packets_raw.json", [r.asDict() for r in raw.toLocalIterator()])
        files += ["i2c/packets.npy", "i2c/packets_raw.json"]
        if decode_i2c:
            pairs, _ = events.key_values(packets.withColumn("text", F.col("packet.text")).drop("packet"), "payload_kind", "text")
            keys = [r.key for r in pairs.select("key").distinct().orderBy("key").collect()]
            for key in keys:
                name = f"decoded_{''.join(c if c.isalnum() or c in '-_' else '_' for c in key)}.npy"
                to_npy(pairs.where(F.col("key") == key).select("timestamp_s", "value", "page_index", "frame_number", "valid", "event_pos"), folder / "i2c" / name, ["page_index", "event_pos"])
                files.append(f"i2c/{name}")
    if figure:
        from planeweave.plans import figures

        try:
            files += figures.overview(rec, folder, formats)
        except Exception as e:  # a figure never stops an export
            rec.warnings.append(f"no figure: {e}")
    manifest = {"created": now(), "recording": rec.name, "source_files": rec.paths, "n_pages": rec.n_pages, "pages_per_file": rec.pages_per_file, "aux_event_counts": counts, "n_i2c_packets": n_packets, "files": files, "qc": report}
    write_json(folder / "manifest.json", manifest)
    return manifest


def project_recording(rec: Recording, out: str | Path | None = None, methods: Sequence[str] = ("mean",), planes: Sequence[int] | None = None, channels: Sequence[int] | None = None, dtype: str = "auto", repeats: str = "pool", limit: int = 0, overwrite: bool = False) -> list[dict]:
    """One TIFF for each method and channel, with a page a volume: the projection of the chosen planes.

    Only the pages that are wanted are read. What can't be done is refused before any is.
    """
    g = rec.geometry
    methods = list(dict.fromkeys(methods))
    if g.n_slices < 2:
        raise ValueError("a projection needs at least two slices")
    if unknown := set(methods) - set(pixels.METHODS):
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    if repeats not in ("pool", "average"):
        raise ValueError(f"repeats are pooled or averaged, not {repeats}")
    repeats = "pool" if g.frames_per_slice <= 1 else repeats
    planes = sorted(set(planes)) if planes is not None else list(range(g.n_slices))
    if not planes or min(planes) < 0 or max(planes) >= g.n_slices:
        raise ValueError(f"planes lie between 0 and {g.n_slices - 1}")
    channels = list(dict.fromkeys(channels)) if channels is not None else g.channels
    if unsaved := [c for c in channels if c not in g.channels]:
        raise ValueError(f"channels {unsaved} are not saved")
    if dtype != "auto" and dtype not in parse.DTYPES:
        raise ValueError(f"unknown dtype: {dtype}")
    n_reduced = len(planes) * (1 if repeats == "average" else g.frames_per_slice)
    if "std" in methods and n_reduced < 2:
        raise ValueError("a deviation needs at least two frames")
    total = g.n_volumes(rec.n_pages)
    if not total:
        raise ValueError("there is no complete volume")
    n = min(total, limit) if limit else total
    folder = Path(out or Path(rec.paths[0]).parent)
    folder.mkdir(parents=True, exist_ok=True)
    targets = {(m, c): folder / f"{rec.name}_{m}_ch{c}.tif" for m in methods for c in channels}
    if not overwrite and (there := [str(p) for p in targets.values() if p.exists()]):
        raise FileExistsError(f"{', '.join(there)} exists")
    h, w = rec.infos[0]["shape"]
    results = []
    for c in channels:
        within = [x for row in layout.page_offsets(planes, g.n_channels, g.frames_per_slice, g.channels.index(c)) for x in row]
        pages = rec.pixels(every=g.pages_per_volume, within=within, page_stop=n * g.pages_per_volume)
        place = layout.page_map(F.col("page_index"), g.n_channels, g.kept_frames, g.frames_per_slice, g.on_disk_frames)
        rows = pages.select(place["volume_index"].alias("volume"), place["slice_index"].alias("plane"), "pixels")
        found = pixels.project_images(rows, ["volume"], "pixels", methods, average="plane" if repeats == "average" else None)
        kinds = {m: dtype if dtype != "auto" else "float32" if m == "std" else str(rec.infos[0]["dtype"]) for m in methods}
        big = {m: tiff.needs_big(n, h * w * np.dtype(kinds[m]).itemsize) for m in methods}
        writers = {m: tiff.Writer(str(targets[m, c]), big[m]) for m in methods}
        zs = [g.zs[p] for p in planes if p < len(g.zs)]
        lines = {"SI.hStackManager.enable": "false", "SI.hFastZ.enable": "false", "SI.hStackManager.actualNumSlices": "1", "SI.hStackManager.numFramesPerVolume": "1", "SI.hStackManager.numFramesPerVolumeWithFlyback": "1", "SI.hStackManager.framesPerSlice": "1", "SI.hChannels.channelSave": str(c)}
        if zs:
            lines["SI.hStackManager.zs"] = format(sum(zs) / len(zs), ".10g")
        if g.volume_rate_hz:
            lines["SI.hRoiManager.scanFrameRate"] = format(g.volume_rate_hz, ".10g")
        software = overridden_text(str(rec.infos[0]["software"]), lines)
        written = 0
        # pages go to the writer in the order of their volumes, as bytes of the type that is written
        for row in as_bytes(found, {m: kinds[m] for m in methods}).orderBy("volume").toLocalIterator(prefetchPartitions=True):
            for m in methods:
                told = {"tool": TOOL, "created": now(), "projection": {"method": m, "planes": planes, "channel": c, "repeats": repeats, "n_reduced_frames": n_reduced, "n_volumes": n, "dtype": kinds[m], "zs": zs, "skipped_volumes": total - n}, "source": {"files": rec.paths, "recording": rec.name}}
                writers[m].add(np.frombuffer(row[m], kinds[m]).reshape(h, w), json.dumps(jsonable(told)) if not written else "", software)
            written += 1
        for m in methods:
            writers[m].close()
            results.append({"path": str(targets[m, c]), "method": m, "channel": c, "n_volumes": written, "skipped_volumes": total - n, "dtype": kinds[m], "bigtiff": big[m]})
    return results


def as_bytes(found: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Projections (volume and an array for each method) with each image as the bytes of its type, half-even and clipped for integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for name, kind in kinds.items():
                images = [x.values.to_numpy(zero_copy_only=False) for x in batch.column(batch.schema.get_field_index(name))]
                if np.dtype(kind).kind in "iu":
                    limits = np.iinfo(kind)
                    images = [np.clip(np.rint(x.astype(np.float32) if name != "max" else x), limits.min, limits.max) for x in images]
                columns.append(pa.array([x.astype(kind).tobytes() for x in images], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["volume", *kinds])

    return found.select("volume", *kinds).mapInArrow(run, "volume bigint, " + ", ".join(f"{m} binary" for m in kinds))


def overridden_text(text: str, values: dict[str, str]) -> str:
    """``key = value`` lines with new values for the keys that are there."""
    out = []
    for line in text.split("\n"):
        key, eq, _ = line.partition("=")
        out.append(f"{key.strip()} = {values[key.strip()]}" if eq and key.strip() in values else line)
    return "\n".join(out)


def save_calibration(table: DataFrame, path: str | Path) -> None:
    """One CSV file, sorted by zoom, an empty field where there is no value."""
    rows = table.select(*CALIBRATION.names).orderBy("zoom").collect()
    text = lambda v: "" if v is None else format(v, ".10g") if isinstance(v, float) else str(v)
    Path(path).write_text("\n".join([",".join(CALIBRATION.names), *(",".join(text(r[c]) for c in CALIBRATION.names) for r in rows)]) + "\n")


def load_calibration(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALIBRATION).option("header", True).csv(str(path)).orderBy("zoom")


def calibrate_grid(spark: SparkSession, inputs: Sequence[str], pitch_um: float = 10.0, center: float = 0.5, min_peaks: int = 5, max_cv: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """(calibration table, measurements) of grid images: each file's average over all pages is measured along its axis."""
    paths = tiff.resolve(list(inputs))
    named = [p for p in paths if re_grid(p)]
    pages = tiff.read_pages(spark, named, pixels=True)
    mean = pixels.project_images(pages, ["file", "height", "width"], "pixels", ["mean"], wide=True)
    heads = spark.createDataFrame([(p, headers.as_float(headers.get(headers.parse(str(tiff.file_info(p)["software"])), "hRoiManager.scanZoomFactor"))) for p in named], "file string, header_zoom double")
    rows = mean.withColumn("g", parse.grid_filename(F.col("file"))).select("file", "height", "width", "mean", F.col("g.axis").alias("axis"), F.col("g.zoom").alias("name_zoom")).join(heads, "file")
    rows = rows.withColumn("z", calibrate.resolve_zoom(F.col("header_zoom"), F.col("name_zoom")))
    rows = rows.select("file", F.col("z.zoom").alias("zoom"), F.col("axis").alias("axis_name"), F.col("z.warning").alias("warning"), "mean", "height", "width", "axis")
    measured = calibrate.measure(rows, ["file", "zoom", "axis_name", "warning"], "mean", "height", "width", "axis", pitch_um=pitch_um, center=center, min_peaks=min_peaks, max_cv=max_cv)
    table = calibrate.calibration_table(measured, "zoom", "axis_name", "um_per_px", "n_peaks", "resolution_px")
    return table.select(*(F.col(f.name).cast(f.dataType) for f in CALIBRATION.fields)), measured


def re_grid(path: str) -> bool:
    return bool(re.search(r"(?i)zoom\d+_\d+_(horizontal|vertical)_\d+$", Path(path).stem))


def scale(spark: SparkSession, calibration: DataFrame, zoom: float, width: int, height: int) -> tuple[float | None, float | None]:
    """Microns a pixel along x and y at ``zoom``, for an image of that size; None outside the calibrated range."""
    out = []
    for a, target in (("x", width), ("y", height)):
        one = spark.createDataFrame([(float(zoom),)], "t double")
        um = calibrate.interpolate(one, calibration, "t", "zoom", f"px_to_micron_{a}").first().value
        known = calibrate.interpolate(one, calibration.withColumn("r", F.col(f"resolution_px_{a}").cast("double")), "t", "zoom", "r").first().value
        out.append(None if um is None else calibrate.rescale(um, known or target, target))
    return out[0], out[1]


def draw_scale_bar(image: np.ndarray, um_per_px: float, length_um: float = 50.0) -> np.ndarray:
    """``image`` stretched to 0-255 with a white bar of ``length_um`` at its lower right."""
    finite = image[np.isfinite(image)]
    low, high = np.percentile(finite, [0.5, 99.5]) if finite.size else (0.0, 1.0)
    high = low + 1 if high <= low else high
    out = (np.clip((np.nan_to_num(image, nan=low) - low) / (high - low), 0, 1) * 255).astype(np.uint8)
    px = max(1, round(length_um / um_per_px))
    if px > image.shape[1]:
        raise ValueError("the bar is longer than the image is wide")
    h, margin = max(1, image.shape[0] // 64), max(1, min(image.shape) // 20)
    margin = min(margin, image.shape[1] - px)
    out[-margin - h : image.shape[0] - margin, image.shape[1] - margin - px : image.shape[1] - margin] = 255
    return out
