import numpy as np
import pytest
from frametide.operators import detect, pixels, traces
from frametide.plans import review as plan
from frametide.sources.media import FRAMES, read_frames, rendered_pan
from frametide.streaming import stateful
from test_detect import A, B, COUNTERS


def run_stream(spark, rows, schema, tmp_path, transform, batches=3):
    """Feeds rows as files of one micro-batch each, in frame order."""
    src = tmp_path / "in"
    edge = sorted({r[1] for r in rows})
    cuts = [edge[len(edge) * k // batches] for k in range(batches)] + [edge[-1] + 1]
    for k in range(batches):
        part = [r for r in rows if cuts[k] <= r[1] < cuts[k + 1]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = transform(stream).writeStream.format("memory").queryName("out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    return spark.table("out").collect()


def test_stream_counter_matches_batch(spark, tmp_path):
    rows = [(s, f, v) for s, (seq, _) in enumerate(COUNTERS) for f, v in enumerate(seq)]
    schema = "session_id long, frame int, value int"
    got = run_stream(spark, rows, schema, tmp_path, stateful.stream_counter_decrements)
    want = detect.counter_decrements(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_stream_edges(spark, tmp_path):
    rows = [(0, f, v) for f, v in enumerate([0.9, None, 0.9, 0.1, 0.95, 0.2])]
    got = run_stream(spark, rows, "session_id long, frame int, score double", tmp_path, stateful.stream_rising_edges)
    assert sorted(r["frame"] for r in got) == [0, 4]


def test_stream_feed(spark, tmp_path):
    frames = [[A]] * 20 + [[B, A]] * 20
    got = run_stream(spark, [(0, f, h) for f, h in enumerate(frames)], "session_id long, frame int, hashes array<long>", tmp_path, stateful.stream_feed_kills, 5)
    assert sorted(r["frame"] for r in got) == [0, 20]


def test_stream_budget(spark, tmp_path):
    rows = [(0, i, usd) for i, usd in enumerate([0.2, 0.2, 0.2, 0.05])]
    got = run_stream(spark, rows, "session_id long, frame int, usd double", tmp_path, lambda s: stateful.stream_budget(s, 0.5), 2)
    assert [r["admitted"] for r in sorted(got, key=lambda r: r["frame"])] == [True, True, False, True]


def frames(spark, images, session="s"):
    rows = [(session, i, i * 1000 / 60, im.shape[1], im.shape[0], im.astype(np.uint8).tobytes()) for i, im in enumerate(images)]
    return spark.createDataFrame(rows, FRAMES)


def test_phash_is_stable_under_noise_and_tells_rows_apart():
    rng = np.random.default_rng(0)
    a, b = (np.kron(rng.integers(0, 255, (8, 16)), np.ones((4, 8))) for _ in range(2))
    noisy = np.clip(a + rng.normal(0, 3, a.shape), 0, 255)
    assert (pixels.phash(a) ^ pixels.phash(noisy)).bit_count() <= 6 < (pixels.phash(a) ^ pixels.phash(b)).bit_count()


def test_feed_rows_and_template(spark):
    rng = np.random.default_rng(1)
    image = np.full((100, 200), 40)
    image[0:20, 20:120] = np.kron(rng.integers(0, 255, (5, 25)), np.ones((4, 4)))
    rows = pixels.feed_rows(frames(spark, [image]), (0.0, 0.0, 1.0, 1.0)).collect()
    assert len(rows) == 5 and rows[0]["std"] > 6 and rows[1]["std"] == 0 and rows[1]["uniformity"] == 1
    template = image[4:14, 40:60].astype(float)
    scores = pixels.hit_scores(frames(spark, [image, np.full((100, 200), 40)]), template, (0.0, 0.0, 1.0, 1.0)).orderBy("frame").collect()
    assert scores[0]["score"] == pytest.approx(1) and scores[1]["score"] == 0
    assert pixels.match_template(image[:5, :5], template) is None


def test_motion_follows_a_rendered_pan(spark):
    yaw = np.linspace(0, 8, 13)
    pan = rendered_pan(len(yaw), 320, 180, yaw, 103.0)
    motion = pixels.motion_estimates(frames(spark, pan))
    got = [r["yaw_deg"] for r in traces.to_trace(motion, 320, 103.0, 60.0).orderBy("i").collect()]
    assert np.abs(np.array(got) - yaw).max() < 1.2
    assert traces.trace_confidence(motion).first()["confidence"] >= 0.8
    blank = pixels.motion_estimates(frames(spark, [np.full((60, 80), 9)] * 4))
    assert traces.trace_confidence(blank).first()["confidence"] == 0


def test_read_frames(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((5, 4, 6), np.uint8))
    got = read_frames(spark, str(tmp_path / "*.npy"))
    assert [(r["frame"], r["w"], r["h"]) for r in got.orderBy("frame").collect()] == [(i, 6, 4) for i in range(5)]
    assert read_frames(spark, str(tmp_path / "a.npy"), start_ms=17, end_ms=50).count() == 2
    np.save(tmp_path / "b.npy", np.zeros((1, 4, 6), np.uint8))
    with pytest.raises(Exception, match="two frames"):
        read_frames(spark, str(tmp_path / "b.npy")).collect()


def test_whole_review(spark):
    shots = spark.createDataFrame([(7, f, 1) for f in (53, 60, 400, 405)], "session_id long, frame int, nth int")
    hits = spark.createDataFrame([(7, 61, 0.9)], "session_id long, frame int, score double")
    spawns = spark.createDataFrame([(7, 40, "target_spawn"), (7, 70, "target_spawn")], "session_id long, frame int, type string")
    lengths = spark.createDataFrame([(7, 600)], "session_id long, n int")
    motion = spark.createDataFrame([(7, i, float(np.sin(i / 9) * 4), 0.5, i % 50 != 0) for i in range(600)], "clip_id long, i int, dx double, dy double, ok boolean")
    events = plan.all_events(shots, hits, [spawns])
    got = {r["source"]["start_ms"]: r for r in plan.review(events, lengths, motion, plan.Settings()).collect()}
    assert len(got) == 2
    first, second = got[0], got[max(got)]
    assert first["measured"]["reaction_time_ms"] == pytest.approx(216.67, abs=0.01) and first["event"]["type"] == "whiff"
    assert second["measured"]["reaction_time_ms"] is None and any("no stimulus" in w for w in second["measured"]["cv_warnings"])
    assert 0 <= first["measured"]["path_efficiency"] <= 1 and first["measured"]["smoothness_sparc"] < 0
