import hashlib
import json

import pytest
from frametide.functions import scalars as fn
from frametide.operators import cost, geometry, records
from frametide.sources import config
from pyspark.sql import functions as F


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def clips(spark):
    rows = [("c1", 7, 30, 210, ["shot", "whiff"], 5, 1, "whiff", 216.7, 16.7, float("nan"), 0.9, ["b", "a"]), ("c2", 7, 0, 180, ["nothing"], 0, 0, "clean_rep", None, None, 0.2, float("inf"), [])]
    return spark.createDataFrame(rows, "clip_id string, session_id long, lo int, hi int, type_set array<string>, shots_fired int, shots_hit int, event_type string, reaction_time_ms double, reaction_time_error_ms double, jitter_ratio double, path_efficiency double, cv_warnings array<string>")


def test_records(spark):
    rec = records.build_records(clips(spark), game="g", fps=60.0, width=1280, height=720)
    got = {r["clip_id"]: json.loads(j["json"]) for r, j in zip(rec.collect(), records.to_json(rec).collect())}
    assert got["c1"]["measured"]["jitter_ratio"] is None and got["c2"]["measured"]["path_efficiency"] is None
    assert got["c1"]["source"] == {"file": None, "game": "g", "start_ms": 500, "end_ms": 3500, "fps": 60.0, "resolution": "1280x720", "content_sha256": None}
    assert got["c1"]["event"]["detected_by"] == ["ammo_decrement"] and got["c2"]["event"]["detected_by"] == ["manual"]
    assert got["c1"]["assessed"]["ai_status"] == "skipped" and got["c1"]["assessed"]["drill"] is None and got["c1"]["assessed"]["evidence"] == []
    lines = {r["clip_id"]: r["line"] for r in records.summary_lines(rec).collect()}
    assert lines["c1"].startswith("500-3500        whiff") and "217+-17ms" in lines["c1"] and "not measurable" in lines["c2"] and lines["c2"].endswith("-")
    assert [r["warning"] for r in records.distinct_warnings(rec).collect()] == ["a", "b"]


def test_validation(spark):
    full = json.dumps(dict.fromkeys(records.REQUIRED))
    rows = [(1, full), (2, '{"summary": 1}'), (3, "[]"), (4, None), (5, "{broken")]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "k int, p string").select("k", records.missing_fields("p")).collect()}
    assert got[1] == [] and "summary" not in got[2] and len(got[2]) == 6
    assert got[3] == got[4] == got[5] == sorted(records.REQUIRED)


def test_content_hash_takes_every_fourth(spark):
    df = spark.createDataFrame([(1, i, bytes([i])) for i in range(10)], "k int, i int, b binary").repartition(4)
    assert records.content_hash(df, ["k"], "i", "b").first()["content_sha256"] == hashlib.sha256(bytes([0, 4, 8])).hexdigest()


def test_admission(spark):
    rows = [("s", i, usd) for i, usd in enumerate([0.2, 0.2, 0.2, 0.05, 0.05, 0.01])]
    got = cost.admit(spark.createDataFrame(rows, "b string, i int, usd double"), "b", ["i"]).orderBy("i").collect()
    assert [r["admitted"] for r in got] == [True, True, False, True, True, False]
    assert got[2]["reason"] == "session limit" and got[3]["spent_before"] == pytest.approx(0.4)


def test_month_limit_over_sessions(spark):
    rows = [("m", s, i, 0.4) for s in range(4) for i in range(2)]
    got = cost.admit(spark.createDataFrame(rows, "b string, s int, i int, usd double"), "b", ["s", "i"], session="s", session_usd=0.5, month_usd=1.0).orderBy("s", "i").collect()
    assert [r["reason"] for r in got] == [None, "session limit", None, "session limit", "month limit", "month limit", "month limit", "month limit"]


def test_token_bucket(spark):
    df = spark.createDataFrame([("b", i, 0.0) for i in range(5)] + [("b", 5, 100.0)], "b string, i int, at double")
    got = cost.token_bucket(df, "b", "at", ["i"]).orderBy("i").collect()
    assert [round(r["wait_s"], 6) for r in got] == [0, 0, 0, 7.5, 15, 0] and got[5]["tokens_left"] == 2


def test_cache(spark):
    cache = spark.createDataFrame([("k", "old", 1.0), ("k", "new", 2.0), ("j", "x", 1.0)], "key string, payload string, created_at double")
    latest = cost.latest_wins(cache)
    assert {r["key"]: r["payload"] for r in latest.collect()} == {"k": "new", "j": "x"}
    asked = spark.createDataFrame([("k",), ("z",), (None,)], "key string")
    assert {r["key"]: r["cached"] for r in cost.with_cache(asked, latest).collect()} == {"k": True, "z": False, None: False}
    assert {r["key"] for r in cost.misses(asked, latest).collect()} == {"z", None}


def test_cache_table_appends(spark, tmp_path):
    path = str(tmp_path / "cache")
    for payload, at in (("a", 1.0), ("b", 2.0)):
        config.put_cache(spark.createDataFrame([("k", payload, at)], "key string, payload string, created_at double"), path)
    assert [r["payload"] for r in cost.latest_wins(config.load_cache(spark, path)).collect()] == ["b"]


def test_outcomes(spark):
    none = F.array().cast("array<string>")
    case = lambda *a: one(spark, cost.outcome(*a).alias("x"))["x"]
    t, f = F.lit(True), F.lit(False)
    assert case(t, f, none, F.lit(1), F.lit(None)) == "cached"
    assert case(f, f, none, F.lit(1), F.lit(None)) == "skipped"
    assert case(f, t, F.array(F.lit("drill")), F.lit(1), F.lit(None)) == "failed"
    assert case(f, t, none, F.lit(1), F.lit(503)) == "failed" and case(f, t, none, F.lit(2), F.lit(None)) == "ok"


def test_text_functions(spark):
    row = one(spark, fn.scrub(F.lit("a sk-ant-abcdefghijklmnopqrst b AIzaAAAAAAAAAAAAAAAAAA sk-short")), fn.key_fingerprint(F.lit("openai"), F.lit("sk-abcdwxyz")), fn.image_tokens(F.lit(1152), F.lit(1152)), fn.text_tokens(F.lit("abcdefg"), F.lit(None)), fn.key_shape(F.lit("openai"), F.lit("sk-" + "a" * 20)), fn.key_shape(F.lit("nobody"), F.lit("x")))
    assert row[0] == "a sk-ant-[REDACTED] b AIza[REDACTED] sk-short"
    assert row[1]["last4"] == "wxyz" and row[1]["sha256_prefix"] == hashlib.sha256(b"sk-abcdwxyz").hexdigest()[:12]
    assert row[2] == int(42 * 42 * 1.15) and row[3] == 1 and row[4] is True and row[5] is None


def test_prices(spark, tmp_path):
    path = tmp_path / "prices.json"
    path.write_text(json.dumps({"_note": "x", "m": {"input": 2.0, "output": 4.0}}))
    asked = spark.createDataFrame([("m", 1000), ("other", 1000)], "model string, input_tokens int")
    got = {r["model"]: r["usd"] for r in cost.price_requests(asked, config.load_prices(spark, str(path))).collect()}
    assert got["m"] == pytest.approx(1000 / 1e6 * 2 + 400 / 1e6 * 4) and got["other"] == 0
    assert config.load_prices(spark, str(tmp_path / "none.json")).count() == 0


def test_profiles(spark, tmp_path):
    (tmp_path / "one.yaml").write_text("game: one\nfov_degrees: 103\nrois:\n  ammo: [0.86, 0.88, 0.11, 0.08]\nflow_exclude:\n  - [0.0, 0.0, 0.2, 0.2]\n")
    row = config.load_profile(spark, "one", str(tmp_path)).first()
    assert row["fov_degrees"] == 103.0 and row["rois"]["ammo"]["w"] == 0.11 and row["target_hsv"] is None
    with pytest.raises(FileNotFoundError, match="one"):
        config.load_profile(spark, "two", str(tmp_path))
    with pytest.raises(ValueError, match="inside the frame"):
        config.parse_profile("game: x\nfov_degrees: 90\nrois:\n  a: [0.5, 0.5, 0.6, 0.1]\n")
    with pytest.raises(ValueError, match="needs fov_degrees"):
        config.parse_profile("game: x\n")


def test_models(spark, tmp_path):
    path = tmp_path / "models.json"
    path.write_text('{"_note": {"x": "y"}, "a": {"clip": "small", "synthesis": "large"}, "b": {"clip": "other"}}')
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "id long, provider string")
    assert {r["id"]: r["model"] for r in cost.model_defaults(asked, config.load_models(spark, str(path))).collect()} == {1: "small", 2: "other"}


def test_regions(spark):
    assert tuple(one(spark, fn.crop_box(F.lit(1920), F.lit(1080), F.lit(0.86), F.lit(0.88), F.lit(0.11), F.lit(0.08)).alias("b"))["b"]) == (1651, 950, 1862, 1036)
    with pytest.raises(Exception, match="empty region"):
        spark.range(1).select(fn.crop_box(F.lit(10), F.lit(10), F.lit(0.5), F.lit(0.5), F.lit(0.01), F.lit(0.5))).collect()
    points = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (1.5, 1.0), (3.0, 0.5)], "x double, y double")
    regions = spark.createDataFrame([(0.5, 0.5, 1.0, 1.0), (2.0, 0.0, 4.0, 0.5)], "x0 double, y0 double, x1 double, y1 double")
    assert sorted((r["x"], r["y"]) for r in geometry.outside_regions(points, regions).collect()) == [(0.0, 0.0), (1.5, 1.0)]


def test_grid_and_fill(spark):
    tiles = geometry.grid_times(spark.createDataFrame([(1, 0.0, 900.0)], "k int, start_ms double, end_ms double"), 9)
    assert [r["t_ms"] for r in tiles.orderBy("tile").collect()] == [50.0 + 100 * i for i in range(9)]
    holes = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, "a", None, "b", None])], "k int, i int, v string")
    assert [r["v"] for r in geometry.fill_forward(holes, ["k"], "i", "v").orderBy("i").collect()] == [None, "a", "a", "b", "b"]


def test_bands(spark):
    got = {r["metric"]: r["verdict"] for r in records.band_compare(spark.createDataFrame([(1, 300.0, 0.1, 0, None)], "k int, reaction_time_ms double, jitter_ratio double, overshoot_count int, path_efficiency double"), ["k"]).collect()}
    assert got == {"reaction_time_ms": "above", "jitter_ratio": "within", "overshoot_count": "within"}
