"""Command line: ``python -m planeweave.cli COMMAND ...``. Exit codes: 0, 1 for failures and QC errors, 2 for bad options."""

from __future__ import annotations

import argparse
import csv
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from planeweave.operators import sweep
from planeweave.plans import export, figures
from planeweave.plans.recording import Recording, read_recording


def session() -> SparkSession:
    spark = SparkSession.builder.appName("planeweave").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="planeweave")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *, out: bool = False, many: bool = True, overwrite: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("inputs", nargs="+" if many else 1)
        p.add_argument("-v", "--verbose", action="store_true")
        p.add_argument("-q", "--quiet", action="store_true")
        if name not in ("calibrate-grid", "scalebar", "pages"):
            p.add_argument("-a", "--acquisition", action="store_true")
        if out:
            p.add_argument("-o", "--out")
        if overwrite:
            p.add_argument("--overwrite", action="store_true")
        return p

    add("info")
    p = add("metadata", out=True, overwrite=True)
    p.add_argument("--flat", action="store_true")
    p.add_argument("--no-rois", action="store_true")
    p = add("triggers", out=True, overwrite=True)
    for option in ("--no-aux", "--no-i2c", "--decode-i2c"):
        p.add_argument(option, action="store_true")
    p = add("plot", out=True)
    p.add_argument("-f", "--format", action="append", choices=["png", "pdf", "svg"])
    p.add_argument("--dpi", type=int, default=150)
    p = add("export", out=True, overwrite=True)
    for option in ("--no-plots", "--decode-i2c", "--flat"):
        p.add_argument(option, action="store_true")
    p.add_argument("-f", "--format", action="append", choices=["png", "pdf", "svg"])
    p.add_argument("--dpi", type=int, default=150)
    p = add("pages", many=False)
    p.add_argument("--start", type=int, default=0)
    p.add_argument("--stop", type=int, default=20)
    p.add_argument("--csv", action="store_true")
    p = add("calibrate-grid", out=True)
    p.add_argument("--pitch-um", type=float, default=10.0)
    p.add_argument("--center-frac", type=float, default=0.5)
    p.add_argument("--min-peaks", type=int, default=5)
    p.add_argument("--max-pitch-cv", type=float, default=0.15)
    p.add_argument("--diagnostics", action="store_true")
    p = add("scalebar", out=True, overwrite=True)
    p.add_argument("-c", "--calibration", required=True)
    p.add_argument("--length-um", type=float, default=50.0)
    p = add("project", out=True, overwrite=True)
    p.add_argument("-m", "--method", action="append", choices=["mean", "max", "std"])
    p.add_argument("--planes", help="as 0,2,5 or 1-4")
    p.add_argument("--channel", type=int, action="append")
    p.add_argument("--dtype", default="auto")
    p.add_argument("--repeats", default="pool", choices=["pool", "average"])
    p.add_argument("--limit", type=int, default=0)
    add("check")
    return top


def numbers(text: str | None) -> list[int] | None:
    """``0,2,5`` and ``1-4`` as numbers."""
    if text is None:
        return None
    found: list[int] = []
    for part in text.split(","):
        low, _, high = part.partition("-")
        found += range(int(low), int(high or low) + 1)
    return found


def recordings(spark: SparkSession, args: argparse.Namespace) -> list[Recording]:
    """One for each input that no earlier one already covers."""
    seen: set[str] = set()
    out = []
    for path in args.inputs:
        if os.path.realpath(path) not in seen:
            rec = read_recording(spark, path, getattr(args, "acquisition", False))
            seen |= {os.path.realpath(p) for p in rec.paths}
            out.append(rec)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    say = (lambda *x: None) if args.quiet else print
    try:
        planes = numbers(getattr(args, "planes", None))
    except ValueError:
        print("planes are given as 0,2,5 or 1-4", file=sys.stderr)
        return 2
    try:
        return run(session(), args, say, planes)
    except (OSError, ValueError) as e:
        if args.verbose:
            raise
        print(e, file=sys.stderr)
        return 1


def run(spark: SparkSession, args: argparse.Namespace, say, planes: list[int] | None) -> int:
    c = args.command
    if c == "calibrate-grid":
        table, measured = export.calibrate_grid(spark, args.inputs, args.pitch_um, args.center_frac, args.min_peaks, args.max_pitch_cv)
        folder = Path(args.out or ".")
        folder.mkdir(parents=True, exist_ok=True)
        export.save_calibration(table, folder / "calibration.csv")
        for r in measured.orderBy("file").collect():
            if args.diagnostics or not r.ok:
                say(r.file, r.axis_name, r.um_per_px, r.reason or "ok")
        return 0
    if c == "pages":
        rec = read_recording(spark, args.inputs[0])
        rows = sweep.page_window(rec.frames, "page_index", args.start, args.stop).orderBy("page_index")
        out = csv.writer(sys.stdout, delimiter="," if args.csv else "\t")
        out.writerow(rows.columns)
        for r in rows.toLocalIterator():
            out.writerow(r)
        return 0
    bad = 0
    for rec in recordings(spark, args):
        if c == "info":
            for k, v in rec.summary().items():
                say(f"{k}: {json.dumps(export.jsonable(v))}")
        elif c == "metadata":
            folder = export.prepare(Path(args.out or Path(rec.paths[0]).parent) / rec.name, args.overwrite)
            export.write_json(folder / "metadata.json", export.build_metadata(rec, args.flat, not args.no_rois))
            export.write_json(folder / "manifest.json", {"created": export.now(), "recording": rec.name, "source_files": rec.paths, "n_pages": rec.n_pages, "files": ["metadata.json"], "qc": None})
        elif c == "triggers":
            export.export_recording(rec, args.out, metadata=False, qc=False, figure=False, aux=not args.no_aux, i2c=not args.no_i2c, decode_i2c=args.decode_i2c, overwrite=args.overwrite)
        elif c == "plot":
            folder = Path(args.out or Path(rec.paths[0]).parent) / rec.name
            folder.mkdir(parents=True, exist_ok=True)
            figures.overview(rec, folder, args.format or ("svg",))
        elif c == "export":
            export.export_recording(rec, args.out, figure=not args.no_plots, decode_i2c=args.decode_i2c, flat=args.flat, formats=args.format or ("svg",), overwrite=args.overwrite)
        elif c == "project":
            for r in export.project_recording(rec, args.out, args.method or ("mean",), planes, args.channel, args.dtype, args.repeats, args.limit, args.overwrite):
                say(r["path"], r["n_volumes"])
        elif c == "scalebar":
            h, w = rec.infos[0]["shape"]
            zoom = rec.get("hRoiManager.scanZoomFactor")
            um, _ = export.scale(spark, export.load_calibration(spark, args.calibration), float(zoom), w, h)
            if um is None:
                raise ValueError(f"zoom {zoom} lies outside the calibration")
            target = Path(args.out or Path(rec.paths[0]).parent) / f"{rec.name}_scalebar.tif"
            if target.exists() and not args.overwrite:
                raise FileExistsError(f"{target} exists")
            import numpy as np

            from planeweave.operators import pixels
            from planeweave.sources import tiff

            mean = np.array(pixels.project_images(rec.pixels(), ["height"], "pixels", ["mean"], wide=True).first().mean).reshape(h, w)
            target.parent.mkdir(parents=True, exist_ok=True)
            with tiff.Writer(str(target)) as f:
                f.add(export.draw_scale_bar(mean, um, args.length_um))
        elif c == "check":
            report = rec.report()
            say(f"{rec.name}: {'ok' if report['ok'] else 'errors'}")
            for i in report["issues"]:
                say(f"  {i['level']} {i['code']}: {i['message']}")
            bad += not report["ok"]
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
