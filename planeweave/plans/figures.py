"""The overview figure as SVG, drawn from the tables of ``operators.series``."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import functions as F

from planeweave.operators import files, series
from planeweave.plans.recording import Recording

WIDTH, PANEL, EDGE = 900, 220, 50
#: Points of a curve that are drawn; more are thinned evenly.
POINTS = 4000


def _scale(values: Sequence[float], low: float, high: float, size: float) -> list[float]:
    span = (high - low) or 1.0
    return [(v - low) / span * size for v in values]


def _panel(title: str, top: float, marks: list[str]) -> str:
    return f'<g transform="translate({EDGE},{top})"><text x="0" y="-8" font-size="13">{title}</text><rect width="{WIDTH - 2 * EDGE}" height="{PANEL - 60}" fill="none" stroke="#999"/>{"".join(marks)}</g>'


def _line(x: Sequence[float], y: Sequence[float], box: tuple[float, float, float, float], color: str = "#225") -> str:
    w, h = WIDTH - 2 * EDGE, PANEL - 60
    xs, ys = _scale(x, box[0], box[1], w), _scale(y, box[2], box[3], h)
    points = " ".join(f"{a:.1f},{h - min(max(b, 0), h):.1f}" for a, b in zip(xs, ys, strict=True))
    return f'<polyline points="{points}" fill="none" stroke="{color}"/>'


def overview(rec: Recording, folder: Path, formats: Sequence[str] = ("svg",)) -> list[str]:
    """Frame intervals, and with events their marks or rates and their running counts: three panels, or one."""
    if set(formats) - {"svg"}:
        raise ValueError("figures are drawn as svg only")
    frames, aux = rec.frames, rec.aux
    intervals = series.frame_interval_series(frames)
    thin = max(1, rec.n_pages // POINTS)
    rows = intervals.where(F.pmod(F.xxhash64("t"), F.lit(thin)) == 0).orderBy("t").collect()
    clip = series.clip_window(intervals).first()
    span = frames.agg(F.min("frame_timestamp_s").alias("a"), F.max("frame_timestamp_s").alias("b")).first()
    marks = []
    if rows and clip.low is not None:
        marks.append(_line([r.t for r in rows], [r.interval_ms for r in rows], (span.a, span.b, clip.low, clip.high)))
    for r in files.boundaries(frames.withColumn("one", F.lit(1)), ["one"], "file_index", "page_index", "frame_timestamp_s").collect():
        x = _scale([r.time], span.a, span.b, WIDTH - 2 * EDGE)[0]
        marks.append(f'<line x1="{x:.1f}" x2="{x:.1f}" y1="0" y2="{PANEL - 60}" stroke="#a33" stroke-dasharray="4"/>')
    panels = [_panel(f"frame interval (ms), median {clip.median:.3f}" if clip.median is not None else "frame interval", 40, marks)]
    lines = [r.aux_line for r in aux.where("timestamp_s >= 0").select("aux_line").distinct().orderBy("aux_line").collect()]
    if lines:
        h = (PANEL - 60) / len(lines)
        raster, counts = [], []
        running = series.cumulative(aux)
        for i, line in enumerate(lines):
            kind, table = series.raster_or_rate(aux, line, span.a, span.b)
            if kind == "raster":
                xs = _scale([r.timestamp_s for r in table.collect()], span.a, span.b, WIDTH - 2 * EDGE)
                raster += [f'<line x1="{x:.1f}" x2="{x:.1f}" y1="{i * h + 2:.1f}" y2="{(i + 1) * h - 2:.1f}" stroke="#225"/>' for x in xs]
            else:
                rate = table.orderBy("t").collect()
                raster.append(_line([r.t for r in rate], [r.rate for r in rate], (span.a, span.b, 0, max(r.rate for r in rate))))
            n = running.where(F.col("aux_line") == line).orderBy("n")
            step = max(1, n.count() // POINTS)
            up = n.where(F.col("n") % step == 0).collect()
            if up:
                counts.append(_line([r.timestamp_s for r in up], [r.n for r in up], (span.a, span.b, 0, up[-1].n)))
        panels += [_panel("events by line", 40 + PANEL, raster), _panel("events so far", 40 + 2 * PANEL, counts)]
    height = 40 + PANEL * len(panels)
    (folder / "overview.svg").write_text(f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{height}" font-family="sans-serif">{"".join(panels)}</svg>')
    return ["overview.svg"]
