import numpy as np
import pytest
from frametide.operators import detect, pixels, traces
from frametide.sources.media import npy_decoder, read_frames, read_raw, rendered_pan
from pyspark.sql import functions as F


def pan(n=8, step=0.6, **more):
    return rendered_pan(n, 320, 180, np.arange(n) * step, 103.0, **more)


def test_motion_has_inliers_tracked_and_spread(spark, tmp_path):
    """A pan is trusted and its shift right; a picture without texture isn't tracked; noise alone isn't trusted."""
    rng = np.random.default_rng(3)
    clips = {"pan": pan(noise=2.0), "blank": np.full((5, 180, 320), 90, np.uint8), "noise": rng.integers(0, 255, (5, 180, 320)).astype(np.uint8)}
    for name, frames in clips.items():
        np.save(tmp_path / f"{name}.npy", frames)
    got = pixels.motion_estimates(read_frames(spark, str(tmp_path), pairs=True)).withColumn("name", F.regexp_extract("clip_id", r"(\w+)\.npy", 1)).collect()
    after = {n: [r for r in got if r["name"] == n and r["i"] > 0] for n in clips}
    assert all(r["ok"] and r["inliers"] >= 24 and r["spread"] > traces.MIN_SPREAD and r["inliers"] <= r["tracked"] for r in after["pan"])
    offsets = np.rint(160 / np.tan(np.radians(51.5)) * np.tan(np.radians(np.arange(8) * 0.6)))
    assert np.abs([r["dx"] for r in sorted(after["pan"], key=lambda r: r["i"])] - np.diff(offsets)).max() < 0.6
    assert all(not r["ok"] and r["tracked"] == 0 for r in after["blank"])
    assert not any(r["ok"] for r in after["noise"])


def test_a_distractor_is_outvoted(spark):
    clean, crowded = (pixels.estimate_motion(*pan(2, 1.2, distractor=d)) for d in (None, (0.2, 0.0)))
    assert abs(clean[0] - crowded[0]) < 0.3 and crowded[2] < crowded[3] and traces.MIN_SPREAD < crowded[4]


def test_pairs_made_while_reading_are_those_of_a_window(spark, tmp_path):
    np.save(tmp_path / "a.npy", pan(6))
    carried = pixels.motion_estimates(read_frames(spark, str(tmp_path), pairs=True))
    assert "Window" not in carried._jdf.queryExecution().executedPlan().toString()
    windowed = pixels.motion_estimates(read_frames(spark, str(tmp_path)))
    assert sorted(map(tuple, carried.collect())) == sorted(map(tuple, windowed.collect()))


@pytest.mark.parametrize(("start", "end"), [(None, None), (50.0, 100.0), (None, 33.4), (90.0, None)])
def test_raw_source_seeks(spark, tmp_path, start, end):
    frames = pan(12)
    np.save(tmp_path / "a.npy", frames)
    got = {r["frame"]: r for r in read_raw(spark, [str(tmp_path / "a.npy")], start_ms=start, end_ms=end, chunk_frames=4).collect()}
    want = [i for i in range(12) if (start is None or i * 1000 / 60 >= start) and (end is None or i * 1000 / 60 <= end)]
    assert sorted(got) == want
    for i in want:
        assert bytes(got[i]["pixels"]) == frames[i].tobytes()
        assert got[i]["before"] is None if i == want[0] else bytes(got[i]["before"]) == frames[i - 1].tobytes()
    whole = read_frames(spark, str(tmp_path), npy_decoder, start_ms=start, end_ms=end, pairs=True).collect()
    assert {r["frame"]: (bytes(r["pixels"]), r["before"]) for r in whole} == {i: (bytes(r["pixels"]), r["before"]) for i, r in got.items()}


def test_a_drawn_counter_reads_back_by_font_templates(spark):
    numbers = [30, 29, 28, 28, 7, 6]
    frames = rendered_pan(len(numbers), 640, 360, np.zeros(len(numbers)), 103.0, counter=numbers, crosshair=True)
    h, w = frames.shape[1:]
    mark = pixels.written_text("30", max(2, h // 40)).shape[0]
    roi = (1 - (w // 4) / w, (h - mark - 12) / h, 1.0, 1.0)
    assert [pixels.read_number(pixels.crop(f, roi), pixels.font_templates())[0] for f in frames] == numbers
    rows = spark.createDataFrame([("s", i, n) for i, n in enumerate(numbers)], "session_id string, frame int, value int")
    assert detect.counter_decrements(rows).count() == 3
    assert (frames[:, h // 2, w // 2 - 6 : w // 2 + 7] == 255).all()


def unpng(data):
    """Height, width and rows of a picture of this module's writer."""
    import struct
    import zlib

    w, h = struct.unpack(">II", data[16:24])
    colour = data[25] == 2
    at, raw = 33, b""
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        if data[at + 4 : at + 8] == b"IDAT":
            raw += data[at + 8 : at + 8 + n]
        at += n + 12
    flat = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(h, -1)[:, 1:]
    return flat.reshape(h, w, 3) if colour else flat


def test_frame_grid(spark):
    bright = [np.full((90, 160), 20 * (i + 1), np.uint8) for i in range(5)]
    rows = [("c", i, i * 0.25, 160, 90, None if i == 3 else im.tobytes()) for i, im in enumerate(bright)] + [("d", 0, 0.0, 160, 90, None)]
    tiles = spark.createDataFrame(rows, "clip_id string, tile int, label_s double, w int, h int, pixels binary")
    got = {r["clip_id"]: unpng(bytes(r["image"])) for r in pixels.frame_grids(tiles, 3, 96).collect()}
    grid = got["c"]
    assert grid.shape == (192, 288) and grid[48, 48] == 20 and grid[48, 48 + 96] == 40
    assert grid[48 + 96, 48] == 60  # the fourth tile repeats the third
    assert grid[2, 40] == 0 and (grid[4:14, 4:40] == 255).any()  # letterbox and label
    assert got["d"].shape == (96, 288)


def test_growing_overlay(spark):
    frames = pan(5)
    rows = [("c", i, 320, 180, f.tobytes()) for i, f in enumerate(frames)]
    clips = spark.createDataFrame([("c", [0.0, 5.0, 10.0, 15.0, 20.0], [0.0] * 5, [0.0, 10.0, 30.0, 20.0, 10.0], [2])], "clip_id string, yaw_deg array<double>, pitch_deg array<double>, speed_dps array<double>, turns array<int>")
    got = pixels.growing_overlays(spark.createDataFrame(rows, "clip_id string, i int, w int, h int, pixels binary"), clips, 103.0).collect()
    images = {r["i"]: unpng(bytes(r["image"])) for r in got}
    assert sorted(images) == [1, 2, 3, 4]
    path = [int((images[i][90, 160:] == (255, 210, 0)).all(axis=-1).sum()) for i in (1, 2, 3, 4)]
    assert path == sorted(path) and path[0] < path[-1]
    turned = [bool((images[i] == (255, 40, 40)).all(axis=-1).any()) for i in (1, 2)]
    assert turned == [False, True]
