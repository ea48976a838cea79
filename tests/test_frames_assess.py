import json

import numpy as np
import pytest
from frametide import __main__ as cli
from frametide.operators import assess, pixels, records
from frametide.plans.recordings import analyze_recordings
from frametide.sources import config
from frametide.sources.media import FRAMES
from pyspark.sql import functions as F
from test_streaming_pixels import frames, run_stream

# A five by three font, drawn large.
FONT = {0: "111101101101111", 1: "010110010010111", 2: "111001111100111", 3: "111001111001111", 4: "101101111001001", 5: "111100111001111", 6: "111100111101111", 7: "111001010010010", 8: "111101111101111", 9: "111101111001111"}


def digit(d, scale=4):
    return np.kron(np.array(list(map(int, FONT[d]))).reshape(5, 3), np.ones((scale, scale))) * 255


def number(n, height=32, width=90):
    out = np.zeros((height, width))
    for k, c in enumerate(str(n)):
        out[6:26, 6 + 18 * k : 18 + 18 * k] = digit(int(c))
    return out.astype(np.uint8)


TEMPLATES = {d: pixels.glyph(digit(d)) for d in FONT}


@pytest.mark.parametrize("n", [*range(0, 31), 45, 90, 100])
def test_counter_is_read_exactly(n):
    assert pixels.read_number(number(n), TEMPLATES)[0] == n
    assert pixels.read_number(255 - number(n), TEMPLATES)[0] == n


def test_unreadable_gives_nothing():
    assert pixels.read_number(np.full((32, 90), 80, np.uint8), TEMPLATES) == (None, 0.0)
    with pytest.raises(ValueError, match="only digits"):
        pixels.read_number(number(1), {11: TEMPLATES[1]})


def test_targets_by_colour():
    image = np.zeros((60, 80, 3), np.uint8)
    image[10:22, 10:22] = (0, 0, 255)
    image[30:50, 40:60] = (0, 0, 255)
    image[5, 70] = (0, 0, 255)
    image[50:58, 5:20] = (255, 0, 0)
    got = pixels.targets(image, [0, 100, 100], [10, 255, 255])
    assert [(round(x, 1), round(y, 1), a) for x, y, a in got] == [(49.5, 39.5, 400.0), (15.5, 15.5, 144.0)]


def test_png_round_trip_header():
    data = pixels.png(np.zeros((3, 5, 3), np.uint8))
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and data[16:24] == (5).to_bytes(4, "big") + (3).to_bytes(4, "big")


def test_recordings_to_records(spark):
    rng = np.random.default_rng(0)
    world = np.kron(rng.integers(30, 120, (30, 80)), np.ones((4, 4)))
    images, ammo = [], 30
    for i in range(40):
        if i in (20, 22, 24):
            ammo -= 1
        image = world[:120, i : i + 200].astype(np.uint8)
        image[80:112, 100:190] = number(ammo)
        images.append(image)
    rows = [("rec", i, i * 1000 / 60, 200, 120, im.tobytes()) for i, im in enumerate(images)]
    profile = config.parse_profile("game: g\nfov_degrees: 90\nrois:\n  ammo: [0.5, 0.66667, 0.45, 0.26667]\nflow_exclude:\n  - [0.5, 0.65, 0.48, 0.3]\n")
    row = spark.createDataFrame([profile], config.PROFILE).first()
    got = analyze_recordings(spark.createDataFrame(rows, FRAMES), row, templates=TEMPLATES).collect()
    assert len(got) == 1 and got[0]["measured"]["shots_fired"] == 3 and got[0]["event"]["type"] == "tracking_phase"
    assert got[0]["event"]["detected_by"] == ["ammo_decrement"] and got[0]["measured"]["peak_angular_error_deg"] > 5
    assert any("hit detection not configured" in w for w in got[0]["measured"]["cv_warnings"])


ANSWER = json.dumps({"primary_weakness": "overshoot", "severity": 2, "confidence": 0.5, "summary": "s", "evidence": [{"t_rel_s": 1.0, "observation": "o"}], "drill": {"name": "n", "target": "t", "rationale": "r"}, "not_determinable": []})


def test_attempts():
    calls = []

    def flaky(prompt, hint):
        calls.append(hint)
        return (ANSWER if hint else "{}"), {"input_tokens": 5}

    payload, error, usage = assess.attempt(flaky, "p")
    assert json.loads(payload)["severity"] == 2 and error is None and usage == {"input_tokens": 5}
    assert calls[0] is None and "missing required fields" in calls[1]

    def refused(prompt, hint):
        calls.append("x")
        raise assess.TransportError("no", 400)

    calls.clear()
    assert assess.attempt(refused, "p")[0] is None and calls == ["x"]
    assert "unusable" in assess.attempt(lambda p, h: ("nope", {}), "p")[1]


def test_assess_and_results(spark):
    asked = spark.createDataFrame([("a" * 40, "k1", "b", 0, "p", 0.2), ("b" * 64, "k2", "b", 1, "p", 0.2), ("c" * 64, "k3", "b", 2, "bad", 0.2), ("d" * 64, "k4", "b", 3, "p", 0.3)], "clip_sha256 string, key string, b string, i int, prompt string, usd double")
    cache = spark.createDataFrame([("k1", ANSWER, 1.0)], "key string, payload string, created_at double")
    call = lambda prompt, hint: (ANSWER if prompt == "p" else "[]", {"input_tokens": 7, "output_tokens": 3})
    out = assess.assess(asked, cache, call, budget_key="b", order=["i"])
    got = {r["key"]: r for r in out.collect()}
    assert {k: r["ai_status"] for k, r in got.items()} == {"k1": "cached", "k2": "ok", "k3": "failed", "k4": "skipped"}
    assert got["k2"]["input_tokens"] == 7 and got["k4"]["error"] == "session limit"
    more = out.withColumns({"file": F.lit("f"), "game": F.lit("g"), "start_ms": F.lit(0), "end_ms": F.lit(1), "event_type": F.lit("kill"), "measured": F.struct(F.lit(0.8).alias("cv_confidence"))})
    recs = {r["assessed"]["ai_status"]: r for r in assess.build_results(more, "p", "m", "1").collect()}
    assert recs["ok"]["assessed"]["drill"]["name"] == "n" and recs["cached"]["provenance"]["cached"] and recs["failed"]["assessed"]["not_determinable"][0].startswith("model returned")
    assert recs["cached"]["session_id"] == "a" * 8 and recs["ok"]["clip_id"] == "b" * 32


def test_prompt(spark):
    p = assess.user_prompt(F.lit("g"), F.lit(1), F.lit(8), F.lit("kill"), F.lit("none"), F.struct(F.lit(None).cast("double").alias("x")), assess.bands_column(), F.array(F.lit(0.17), F.lit(0.5)))
    text = spark.range(1).select(p.alias("p")).first()["p"]
    assert "Clip 01 of 08 from g" in text and '{"x":null}' in text and "[0.17, 0.50]" in text and all(m in text for m in records.BANDS)


def test_stream_spawns_and_bucket(spark, tmp_path):
    from frametide.streaming import stateful

    counts = [0] * 10 + [1] * 12 + [2] * 3 + [1] * 8
    got = run_stream(spark, [(0, i, c) for i, c in enumerate(counts)], "session_id long, frame int, n_targets int", tmp_path / "a", stateful.stream_target_spawns, 4)
    assert [(r["frame"], r["n_targets"]) for r in got] == [(10, 1)]
    got = run_stream(spark, [(0, i, 0.0) for i in range(5)], "session_id long, frame int, at double", tmp_path / "b", lambda s: stateful.stream_token_bucket(s, 8 / 60, 3.0), 2)
    assert [round(r["wait_s"], 6) for r in sorted(got, key=lambda r: r["frame"])] == [0, 0, 0, 7.5, 15]


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "one.yaml").write_text("game: one\n")
    assert cli.main(["profiles", "--profiles", str(tmp_path)]) == 0 and capsys.readouterr().out == "one\n"
    assert cli.main(["doctor"]) == 0 and "spark" in capsys.readouterr().out
    assert cli.main(["analyze", "none", "--profile", "two", "--profiles", str(tmp_path)]) == 1
    assert cli.main(["selftest"]) == 0
    np.save(tmp_path / "a.npy", np.random.default_rng(0).integers(0, 255, (6, 40, 60)).astype(np.uint8))
    assert cli.main(["overlay", str(tmp_path / "a.npy"), "--out", str(tmp_path / "o.png")]) == 0
    assert (tmp_path / "o.png").read_bytes()[1:4] == b"PNG"
    assert frames(spark, [np.zeros((2, 2))]).count() == 1
