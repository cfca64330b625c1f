"""Files from the package's own writer through scan, frames, events, quality control, projection, export and command line."""

from __future__ import annotations

import csv
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from planeweave import cli
from planeweave.operators import calibrate, events, series
from planeweave.plans import export
from planeweave.plans.recording import find_acquisition_files, read_recording
from planeweave.sources import tiff
from tests.conftest import PERIOD, VOLUMES, header_text, page_text, write


def images(path):
    with open(path, "rb") as f:
        lay, first = tiff.open_layout(f)
        return [tiff.pixels(f, lay, p) for p in tiff.walk(f, lay, first)[0]]


def codes(rec):
    return [r.code for r in rec.findings().collect()]


@pytest.mark.parametrize("big", [False, True])
def test_scan_round_trip(spark, tmp_path, big):
    p = write(tmp_path / "a.tif", 5, header_text(), big=big)
    info = tiff.file_info(p)
    assert (len(info["places"]), info["bigtiff"], info["shape"], info["dtype"], info["warning"]) == (5, big, (4, 4), "int16", "")
    rows = tiff.read_pages(spark, [p], pixels=True, block=2).orderBy("page_index").collect()
    assert [r.page_index for r in rows] == list(range(5)) and all(set(r.pixels) == {float(r.page_index)} for r in rows)
    assert tiff.read_pages(spark, [p], page_start=1, page_stop=3).count() == 2
    assert [r.page_index for r in tiff.read_pages(spark, [p], every=4, within=[0, 2]).orderBy("page_index").collect()] == [0, 2, 4]


def test_chain_guards(tmp_path):
    p = write(tmp_path / "a.tif", 3, header_text())
    places = tiff.file_info(p)["places"]
    raw = bytearray(open(p, "rb").read())
    n = struct.unpack("<H", raw[places[2] : places[2] + 2])[0]
    at = places[2] + 2 + 12 * n
    for target, said in ((places[0], "back"), (10**8, "beyond")):
        raw[at : at + 4] = struct.pack("<I", target)
        (tmp_path / "b.tif").write_bytes(raw)
        info = tiff.file_info(str(tmp_path / "b.tif"))
        assert len(info["places"]) == 3 and said in info["warning"]
    (tmp_path / "c.tif").write_bytes(b"no image")
    with pytest.raises(tiff.TiffError):
        tiff.file_info(str(tmp_path / "c.tif"))


def test_single_plane(spark, tmp_path):
    rec = read_recording(spark, write(tmp_path / "one.tif", 20, header_text(), aux={3, 11}))
    frames = rec.frames.orderBy("page_index").collect()
    assert [f.frame_number for f in frames] == list(range(1, 21)) and frames[3].n_aux0 == 1 and frames[0].acq_trigger_timestamp_s == -1
    aux = rec.aux.orderBy("page_index").collect()
    assert [a.frame_number for a in aux] == [4, 12] and all(abs(a.offset_in_frame_s - PERIOD / 3) < 1e-6 for a in aux)
    report = rec.report()
    assert report["ok"] and [i["code"] for i in report["issues"]] == ["no_end_of_acquisition"]
    s = rec.summary()
    assert s["epoch"] == "2024-02-29T06:05:04.250000" and s["si_version"] == "2022.1.0" and abs(s["duration_s"] - 19 * PERIOD) < 1e-6
    assert rec.trigger_summary()["aux_lines_empty"] == [1, 2, 3]


def test_volumes(spark, tmp_path):
    rec = read_recording(spark, write(tmp_path / "v.tif", 24, header_text(**VOLUMES), aux={5}))
    e = rec.aux.first()
    assert (e.volume_index, e.slice_index) == (1, 1) and abs(e.volume_timestamp_s - 4 * PERIOD) < 1e-6
    assert rec.summary()["n_volumes"] == 6 and "volume_rate_mismatch" not in codes(rec)


def test_channels(spark, tmp_path):
    rec = read_recording(spark, write(tmp_path / "c.tif", 16, header_text(hChannels__channelSave=[1, 2]), channels=2))
    assert [r.channel for r in rec.frames.orderBy("page_index").limit(4).collect()] == [0, 1, 0, 1]
    assert "frame_number_repeats" not in codes(rec)


def test_split_acquisition(spark, tmp_path):
    a = write(tmp_path / "m_00001_00001.tif", 10, header_text(), aux={2})
    b = write(tmp_path / "m_00001_00002.tif", 10, header_text(), aux={4}, first=10)
    write(tmp_path / "m_00001_00003.tif", 10, header_text(hRoiManager__scanZoomFactor=9))
    (tmp_path / "m_00001_00004.tif").write_bytes(b"broken")
    paths, warnings = find_acquisition_files(b)
    assert paths == [a, b] and len(warnings) == 2
    rec = read_recording(spark, b, acquisition=True)
    assert rec.name == "m_00001" and rec.n_pages == 20
    frames = rec.frames.orderBy("page_index").collect()
    assert [f.page_index for f in frames] == list(range(20)) and [f.file_index for f in frames] == [0] * 10 + [1] * 10 and frames[10].volume_index == 0
    assert [(e.page_index, e.file_index) for e in rec.aux.orderBy("page_index").collect()] == [(2, 0), (14, 1)]


def test_findings(spark, tmp_path):
    times = [0, 0.033, 0.066, 0.132, 0.165]
    rec = read_recording(spark, write(tmp_path / "j.tif", 5, header_text(), times=times))
    assert {(r.level, r.code) for r in rec.findings().collect()} >= {("error", "timestamp_jitter")}
    rec = read_recording(spark, write(tmp_path / "m.tif", 4, header_text(), times=[0, 0.033, 0.02, 0.1]))
    assert "timestamp_not_monotonic" in codes(rec)
    rec = read_recording(spark, write(tmp_path / "t.tif", 5, header_text(), cut={2: 12}))
    found = {r.code: r for r in rec.findings().collect()}
    assert found["truncated_page_header"].level == "error" and found["truncated_page_header"].details["first_page"] == "2"
    rec = read_recording(spark, write(tmp_path / "k.tif", 3, header_text(), extra={p: {"gain": 1} for p in range(3)}))
    assert "unknown_page_keys" in codes(rec) and "page_header_drift" not in codes(rec)
    rec = read_recording(spark, write(tmp_path / "p.tif", 22, header_text(**VOLUMES)))
    assert "partial_volume" in codes(rec)
    bad = VOLUMES | {"hStackManager__actualNumSlices": 2}
    assert codes(read_recording(spark, write(tmp_path / "g.tif", 8, header_text(**bad))))[:2] == ["read_warning", "geometry_fallback"]


def test_packets_and_pairs(spark, tmp_path):
    i2c = {1: "{{0.04, 'treadmill_9'} {0.05, 'treadmill_10'}}", 2: "{{0.07, 'lick_1'}}", 3: "{{-1, 'lick_2'}}"}
    rec = read_recording(spark, write(tmp_path / "i.tif", 6, header_text(), i2c=i2c))
    rows = rec.i2c.orderBy("page_index", "event_pos").collect()
    assert [r.valid for r in rows] == [True, True, True, False] and rows[0].payload_length == 11
    pairs, why = events.key_values(rec.i2c.where("valid").withColumn("text", F.col("packet.text")), "payload_kind", "text")
    assert sorted((r.key, r.value) for r in pairs.collect()) == [("lick", 1.0), ("treadmill", 9.0), ("treadmill", 10.0)] and why.first().reason is None
    mixed = rec.i2c.withColumn("text", F.when(F.col("page_index") == 2, "words").otherwise(F.col("packet.text")))
    pairs, why = events.key_values(mixed, "payload_kind", "text")
    assert pairs.count() == 0 and why.first().reason
    assert "i2c_invalid_timestamp" in codes(rec)


@pytest.mark.parametrize(("n", "expected"), [(24, [1, 5, 9, 13, 17, 21]), (22, [1, 5, 9, 13, 17])])
def test_projection_values(spark, tmp_path, n, expected):
    rec = read_recording(spark, write(tmp_path / "v.tif", n, header_text(**VOLUMES)))
    out = {r["method"]: r for r in export.project_recording(rec, tmp_path / "p", ["mean", "max", "std"])}
    assert [int(i[0, 0]) for i in images(out["mean"]["path"])] == expected
    assert [int(i[0, 0]) for i in images(out["max"]["path"])] == [v + 1 for v in expected]
    std = images(out["std"]["path"])
    assert std[0].dtype == np.float32 and np.allclose(std, np.std([0, 1, 2]))
    again = read_recording(spark, out["mean"]["path"])
    assert again.get("hStackManager.zs") == 20 and again.get("hRoiManager.scanFrameRate") == 7.5 and not again.geometry.volumetric
    with pytest.raises(FileExistsError):
        export.project_recording(rec, tmp_path / "p", ["mean"])


def test_projection_channels_and_repeats(spark, tmp_path):
    rec = read_recording(spark, write(tmp_path / "c.tif", 48, header_text(**VOLUMES, hChannels__channelSave=[1, 2]), channels=2))
    out = export.project_recording(rec, tmp_path / "p")
    assert [[int(i[0, 0]) for i in images(r["path"])][:2] for r in out] == [[2, 10], [3, 11]]
    odd = VOLUMES | dict(hStackManager__actualNumSlices=2, hStackManager__framesPerSlice=3, hStackManager__numFramesPerVolume=6, hStackManager__numFramesPerVolumeWithFlyback=7, hStackManager__zs=[1, 2])
    rec = read_recording(spark, write(tmp_path / "r.tif", 14, header_text(**odd)))
    pool = export.project_recording(rec, tmp_path / "q", ["mean"], dtype="float32")
    assert [float(i[0, 0]) for i in images(pool[0]["path"])] == [2.5, 9.5]
    mean = {r["method"]: images(r["path"]) for r in export.project_recording(rec, tmp_path / "s", ["max", "std"], dtype="float32", repeats="average")}
    assert [float(i[0, 0]) for i in mean["max"]] == [4, 11] and [float(i[0, 0]) for i in mean["std"]] == [1.5, 1.5]


def test_projection_refusals(spark, tmp_path):
    flat = read_recording(spark, write(tmp_path / "f.tif", 4, header_text()))
    rec = read_recording(spark, write(tmp_path / "v.tif", 8, header_text(**VOLUMES)))
    for r, how in ((flat, {}), (rec, {"methods": ["median"]}), (rec, {"planes": [7]}), (rec, {"channels": [3]}), (rec, {"dtype": "int9"}), (rec, {"repeats": "x"}), (rec, {"methods": ["std"], "planes": [1]})):
        with pytest.raises(ValueError):
            export.project_recording(r, tmp_path / "o", **how)
    assert not (tmp_path / "o").exists()


def grid(path, pitch, n=100):
    image = np.full((n, n), 1000, np.int16)
    image[:, ::pitch] = 10
    with tiff.Writer(str(path)) as f:
        for _ in range(2):
            f.add(image if "horizontal" in path.name else image.T, page_text(1, 0.0), header_text(hRoiManager__scanZoomFactor=2 if "zoom2" in path.name else 4))


def test_calibration(spark, tmp_path):
    for zoom, pitch in ((2, 8), (4, 16)):
        for axis in ("horizontal", "vertical"):
            grid(tmp_path / f"zoom{zoom}_0_{axis}_1.tif", pitch)
    table, measured = export.calibrate_grid(spark, [str(tmp_path)])
    assert all(r.ok for r in measured.collect())
    export.save_calibration(table, tmp_path / "c.csv")
    back = export.load_calibration(spark, str(tmp_path / "c.csv")).collect()
    assert [(r.zoom, r.px_to_micron_x, r.px_to_micron_y, r.resolution_px_x) for r in back] == [(2.0, 1.25, 1.25, 100), (4.0, 0.625, 0.625, 100)]
    cal = export.load_calibration(spark, str(tmp_path / "c.csv"))
    assert export.scale(spark, cal, 3, 100, 200) == (0.9375, 0.46875)
    assert export.scale(spark, cal, 9, 100, 100) == (None, None)


def test_pitch_is_doubtful_not_an_error():
    assert calibrate.measure_pitch(np.ones((10, 10)), "x").reason == "no contrast"
    y = np.ones((10, 40))
    y[:, [10, 20]] = 0
    m = calibrate.measure_pitch(y, "x")
    assert m.pitch_px == 10 and not m.ok and m.n_peaks == 2
    assert calibrate.find_peaks(np.array([0, 2, 2, 2, 0, 1, 0.0])).tolist() == [2, 5]
    assert calibrate.find_peaks(np.array([0, 3, 0, 2, 0, 1, 0.0]), distance=3).tolist() == [1, 5]
    with pytest.raises(ValueError):
        calibrate.measure_pitch(y, "x", center=0)
    bar = export.draw_scale_bar(np.arange(10000.0).reshape(100, 100), 2.0, 50)
    assert (bar[-6] == 255).sum() >= 25


def test_export(spark, tmp_path):
    rec = read_recording(spark, write(tmp_path / "e.tif", 12, header_text(), aux={3}, i2c={2: "{{0.07, 'lick_1'}}", 4: "{{-1, 'x'}}"}))
    m = export.export_recording(rec, tmp_path / "out", decode_i2c=True)
    folder = tmp_path / "out" / "e"
    assert np.load(folder / "frames.npy")["frame_number"].tolist() == list(range(1, 13))
    assert len(np.load(folder / "aux_triggers" / "aux0.npy")) == 1 and not (folder / "aux_triggers" / "aux1.npy").exists()
    assert np.load(folder / "i2c" / "decoded_lick.npy")["value"].tolist() == [1.0]
    meta = json.loads((folder / "metadata.json").read_text())
    assert meta["scanimage"]["FrameData"]["SI"]["hBeams"]["lengthConstants"] == "Infinity"
    assert m["n_i2c_packets"] == 1 and m["aux_event_counts"] == {"aux0": 1} and "overview.svg" in m["files"] and "manifest.json" not in m["files"]
    with pytest.raises(FileExistsError):
        export.export_recording(rec, tmp_path / "out")


def test_series(spark, tmp_path):
    rec = read_recording(spark, write(tmp_path / "s.tif", 12, header_text(), aux={3, 5}))
    t = series.frame_interval_series(rec.frames)
    assert t.count() == 11 and abs(series.clip_window(t).first().median - 1000 * PERIOD) < 1e-3
    assert [r.n for r in series.cumulative(rec.aux).orderBy("n").collect()] == [1, 2]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    p = write(tmp_path / "v.tif", 24, header_text(**VOLUMES), aux={5})
    assert cli.main(["info", p]) == 0 and "n_volumes: 6" in capsys.readouterr().out
    assert cli.main(["pages", p, "--csv", "--stop", "3"]) == 0 and len(list(csv.reader(capsys.readouterr().out.splitlines()))) == 4
    assert cli.main(["check", p]) == 0
    assert cli.main(["check", write(tmp_path / "m.tif", 4, header_text(), times=[0, 0.033, 0.02, 0.1])]) == 1
    assert cli.main(["metadata", p, "-o", str(tmp_path / "o")]) == 0 and json.loads((tmp_path / "o/v/manifest.json").read_text())["qc"] is None
    assert cli.main(["metadata", p, "-o", str(tmp_path / "o")]) == 1
    assert cli.main(["triggers", p, "-o", str(tmp_path / "t")]) == 0 and (tmp_path / "t/v/aux_triggers/aux0.npy").exists()
    assert cli.main(["plot", p, "-o", str(tmp_path / "f")]) == 0 and (tmp_path / "f/v/overview.svg").exists()
    assert cli.main(["project", p, "-o", str(tmp_path / "q"), "--planes", "0-1", "--limit", "2"]) == 0
    assert [float(i[0, 0]) for i in images(tmp_path / "q" / "v_mean_ch1.tif")] == [0, 4]  # 0.5 and 4.5, half-even
    assert cli.main(["project", p, "--planes", "a"]) == 2
    assert cli.main(["info", str(tmp_path / "none.tif")]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["project", p, "-m", "median"])
    assert e.value.code == 2
