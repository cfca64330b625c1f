"""A recording: one file or a split acquisition, as lazy tables with what its headers say."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeweave.functions import parse
from planeweave.operators import qc, sweep
from planeweave.operators.files import PER_FILE_KEYS
from planeweave.sources import header as headers
from planeweave.sources import tiff

RECORDING = "recording_id"


def split_name(path: str) -> tuple[str, int | None, int | None]:
    """(base, acquisition, file index) of a file name, as ``parse.filename_parts`` gives them for columns."""
    stem = Path(path).stem
    if m := re.fullmatch(r"(.+?)_(\d+)_(\d+)", stem):
        return m[1], int(m[2]), int(m[3])
    if m := re.fullmatch(r"(.+?)_(\d+)", stem):
        return m[1], int(m[2]), None
    return stem, None, None


def natural(path: str) -> list:
    return [(0, int(x), "") if x.isdigit() else (1, 0, x.lower()) for x in re.findall(r"\d+|\D+", path)]


def find_acquisition_files(path: str) -> tuple[list[str], list[str]]:
    """The files of the acquisition that ``path`` belongs to, in order, and warnings.

    Siblings share base and acquisition, have a file index, and say the same in their headers but for the keys that differ from
    file to file; all are compared with the first. One that can't be read is left out.
    """
    base, acq, index = split_name(path)
    if acq is None or index is None:
        return [path], []
    found = sorted((str(p) for p in Path(path).parent.iterdir() if p.suffix.lower() in (".tif", ".tiff") and split_name(str(p))[:2] == (base, acq) and split_name(str(p))[2] is not None), key=natural)
    kept, warnings, first = [], [], None
    for p in found:
        try:
            h = {k: v for k, v in headers.parse(str(tiff.file_info(p)["software"])).items() if k not in PER_FILE_KEYS}
        except (OSError, ValueError) as e:
            warnings.append(f"{Path(p).name} cannot be read: {e}")
            continue
        first = h if first is None else first
        if repr(sorted(h.items())) == repr(sorted(first.items())):
            kept.append(p)
        else:
            warnings.append(f"{Path(p).name} has another header and is left out")
    if os.path.abspath(path) not in map(os.path.abspath, kept):
        warnings.append(f"{Path(path).name} itself is not among the files of its acquisition")
    return kept or [path], warnings


def written(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared checkpoint folder and read from there; in local mode alone the folder may be our own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="planeweave-"))
    return df.checkpoint()


@dataclass
class Recording:
    """Lazy tables ``frames``, ``aux`` and ``i2c``, with the header and layout of the first file."""

    spark: SparkSession
    infos: list[dict]
    warnings: list[str] = field(default_factory=list)

    @property
    def paths(self) -> list[str]:
        return [str(i["path"]) for i in self.infos]

    @property
    def name(self) -> str:
        stem = Path(self.paths[0]).stem
        base, acq, _ = split_name(self.paths[0])
        return f"{base}_{acq:05d}" if len(self.infos) > 1 and acq is not None else stem

    @property
    def pages_per_file(self) -> list[int]:
        return [len(i["places"]) for i in self.infos]

    @property
    def n_pages(self) -> int:
        return sum(self.pages_per_file)

    @cached_property
    def header(self) -> dict:
        return headers.parse(str(self.infos[0]["software"]))

    @cached_property
    def geometry(self) -> headers.Geometry:
        return headers.geometry(self.header, self.pages_per_file[0])

    def get(self, key: str, default: object = None) -> object:
        return headers.get(self.header, key, default)

    @cached_property
    def pages(self) -> DataFrame:
        """Header texts with page_index through all files and file_page_index within each."""
        starts, n = [], 0
        for k in self.pages_per_file:
            starts.append(n)
            n += k
        start = F.element_at(F.array(*(F.lit(s).cast("bigint") for s in starts)), F.col("file_index") + 1)
        return tiff.read_pages(self.spark, self.paths).withColumn("file_page_index", F.col("page_index") - start)

    @cached_property
    def _framed(self) -> DataFrame:
        g = self.geometry
        return sweep.frames(self.pages, g.n_channels, g.kept_frames, g.frames_per_slice, g.on_disk_frames, keep_entries=True)

    @property
    def frames(self) -> DataFrame:
        return self._framed.drop("_entries")

    @property
    def aux(self) -> DataFrame:
        return sweep.aux_events(self._framed)

    @property
    def i2c(self) -> DataFrame:
        return sweep.i2c_events(self._framed)

    def pixels(self, **options: object) -> DataFrame:
        return tiff.read_pages(self.spark, self.paths, pixels=True, **options)

    def epoch(self) -> object:
        """When the recording began, as the first page says."""
        first = tiff.read_pages(self.spark, self.paths[:1], page_stop=1)
        row = first.select(parse.epoch(parse.lookup(parse.description(F.col("description")), "epoch")).alias("e")).first()
        return row.e if row else None

    def summary(self) -> dict:
        """What the recording is, in a few dozen entries."""
        g, info = self.geometry, self.infos[0]
        times = self.frames.where(parse.is_finite(F.col("frame_timestamp_s"))).agg(F.count("*").alias("n"), F.min("frame_timestamp_s").alias("a"), F.max("frame_timestamp_s").alias("b")).first()
        epoch = self.epoch()
        named = {
            "zoom": "hRoiManager.scanZoomFactor", "pixels_per_line": "hRoiManager.pixelsPerLine", "lines_per_frame": "hRoiManager.linesPerFrame",
            "objective_resolution": "objectiveResolution", "scanner_type": "hScan2D.scannerType", "scanner_name": "hScan2D.name",
            "bidirectional": "hScan2D.bidirectional", "mroi_enabled": "hRoiManager.mroiEnable", "sample_position": "hMotors.samplePosition", "axes_position": "hMotors.axesPosition",
        }
        version = [str(self.get(f"VERSION_{p}")) for p in ("MAJOR", "MINOR", "UPDATE") if self.get(f"VERSION_{p}") is not None]
        return {
            "n_pages": self.n_pages, "n_files": len(self.infos), "pages_per_file": self.pages_per_file, "image_shape": list(info["shape"]), "dtype": info["dtype"],
            "bigtiff": info["bigtiff"], "n_channels": g.n_channels, "channels_saved": g.channels, "volumetric": g.volumetric, "n_slices": g.n_slices,
            "frames_per_slice": g.frames_per_slice, "flyback_frames": g.flyback_frames, "pages_per_volume": g.pages_per_volume, "n_volumes": g.n_volumes(self.n_pages),
            "zs": g.zs, "frame_rate_hz": g.frame_rate_hz, "volume_rate_hz": g.volume_rate_hz, "duration_s": times.b - times.a if times.n >= 2 else None,
            "epoch": epoch.isoformat() if epoch else None, "si_version": ".".join(version), **{k: self.get(v) for k, v in named.items()},
        }

    def trigger_summary(self) -> dict:
        """Triggers by line, lines that are empty, and packets."""
        from planeweave.operators import events

        lines = {r.aux_line: {k: v for k, v in r.asDict().items() if k != "aux_line" and v is not None} for r in events.summarize(self.aux, ["aux_line"]).collect()}
        packets = self.i2c
        told = [r.asDict() for r in events.summarize(packets.withColumn("all", F.lit(1)), ["all"]).drop("all").collect()]
        kinds = [r.asDict() for r in events.payload_kinds(packets.withColumn("all", F.lit(1)), ["all"]).drop("all").collect()]
        sizes = packets.agg(F.min("payload_length").alias("min_payload_length"), F.max("payload_length").alias("max_payload_length")).first().asDict()
        return {"aux": {f"aux{k}": v for k, v in sorted(lines.items())}, "aux_lines_present": sorted(lines), "aux_lines_empty": sorted({0, 1, 2, 3} - set(lines)), "i2c": {**told[0], **kinds[0], **sizes} if told else {"n_events": 0}}

    def findings(self) -> DataFrame:
        """The quality-control report, in its order."""
        g, by = self.geometry, [RECORDING]
        named = lambda df: df.withColumn(RECORDING, F.lit(self.name))
        said = [("warning", "read_warning", w) for w in self.warnings] + ([("warning", "read_warning", g.warning), ("warning", "geometry_fallback", g.warning)] if g.warning else [])
        said += [("error", "no_pages", "there are no pages")] if not self.n_pages else []
        schema = f"{RECORDING} string, level string, code string, message string, n bigint, details map<string,string>"
        out = self.spark.createDataFrame([(self.name, level, code, text, 1, {}) for level, code, text in said], schema)
        if not self.n_pages:
            return qc.in_order(out)
        # pages are swept once for all findings
        framed = written(named(self._framed))
        frames, aux, i2c = framed.drop("_entries"), written(named(sweep.aux_events(framed))), written(named(sweep.i2c_events(framed)))
        first = written(sweep.first_channel(frames, "channel", by).select(*by, "page_index", "frame_timestamp_s"))
        counts = written(sweep.signature_counts(sweep.signatures(named(self.pages), "description", "page_index", by), "page_index", by))
        line = [*by, "aux_line"]
        found = [
            qc.frame_number_missing(frames, by, "frame_number"), qc.frame_number_repeats(frames, by, "frame_number", g.n_channels), qc.frame_number_gaps(frames, by, "frame_number"),
            qc.timestamp_unreadable(first, by, "frame_timestamp_s"), qc.timestamp_negative(first, by, "frame_timestamp_s"),
            qc.timestamp_not_monotonic(first, by, "page_index", "frame_timestamp_s"), qc.timestamp_jitter(first, by, "page_index", "frame_timestamp_s"),
            qc.partial_volume(frames, by, g.pages_per_volume), qc.truncated_page_header(counts, by), qc.page_header_drift(counts, by),
            qc.unknown_page_keys(sweep.unknown_keys(named(self.pages), "description", "page_index", by), by),
            qc.no_end_of_acquisition(frames, by), qc.dc_over_voltage(frames, by),
            qc.aux_negative_timestamp(aux, line, "timestamp_s").drop("aux_line"), qc.aux_not_monotonic(aux.withColumn("_o", F.col("page_index") * 1000 + F.col("event_pos")), line, "_o", "timestamp_s").drop("aux_line"),
            qc.i2c_invalid_timestamp(i2c, by, "timestamp_s"),
        ]
        if g.volumetric:
            found.append(qc.volume_timing(frames, by, "page_index", "frame_timestamp_s", g.pages_per_volume, g.volume_rate_hz))
        for f in found:
            out = out.unionByName(f)
        return qc.in_order(out)

    def stats(self) -> dict:
        """Numbers that go with the findings."""
        g = self.geometry
        frames = self.frames.withColumn(RECORDING, F.lit(self.name))
        numbers = frames.where("frame_number >= 0").agg(F.min("frame_number").alias("first_frame_number"), F.max("frame_number").alias("last_frame_number"), F.countDistinct("frame_number").alias("n_unique_frame_numbers")).first().asDict()
        first = sweep.first_channel(frames, "channel", [RECORDING])
        steps = qc._steps(first, [RECORDING], "page_index", "frame_timestamp_s")
        out = {**numbers, "pages_per_volume": g.pages_per_volume, "n_volumes": g.n_volumes(self.n_pages)}
        for name, rows in (("frame", steps), *([("volume", qc.volume_steps(frames, [RECORDING], "page_index", "frame_timestamp_s", g.pages_per_volume))] if g.volumetric else [])):
            for r in qc.pixels.jitter(rows, [RECORDING], "interval").collect():
                out |= {f"median_{name}_interval_s": r.median_interval, f"{name}_interval_rms_jitter": r.rms_jitter, f"{name}_interval_max_deviation": r.max_deviation}
                if r.median_interval > 0:
                    out["implied_frame_rate_hz" if name == "frame" else "implied_volume_rate_hz"] = 1 / r.median_interval
        if "implied_volume_rate_hz" in out and g.volume_rate_hz:
            out["volume_rate_header_deviation"] = abs(out["implied_volume_rate_hz"] / g.volume_rate_hz - 1)
        return out

    def report(self) -> dict:
        """ok, counts, stats and issues; an issue without details has none."""
        issues = []
        for r in self.findings().collect():
            issue = {"level": r.level, "code": r.code, "message": r.message}
            issues.append(issue | ({"details": dict(r.details)} if r.details else {}))
        n = {level: sum(i["level"] == level for i in issues) for level in ("error", "warning")}
        return {"ok": not n["error"], "n_errors": n["error"], "n_warnings": n["warning"], "stats": self.stats() if self.n_pages else {}, "issues": issues}


def read_recording(spark: SparkSession, path: str | Sequence[str], acquisition: bool = False) -> Recording:
    """A file, given files, or with ``acquisition`` the whole acquisition that a file belongs to."""
    warnings: list[str] = []
    paths = [path] if isinstance(path, str) else list(path)
    if acquisition and len(paths) == 1:
        paths, warnings = find_acquisition_files(paths[0])
    infos = [tiff.file_info(p) for p in paths]
    warnings += [f"{Path(str(i['path'])).name}: {i['warning']}" for i in infos if i["warning"]]
    return Recording(spark, infos, warnings)
