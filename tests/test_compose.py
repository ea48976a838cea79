import random

import pytest
from frametide.operators import compose, select
from pyspark.sql import functions as F


def stream(spark, frames, name):
    return spark.createDataFrame([(s, f, i) for s, fs in frames.items() for i, f in enumerate(fs)], f"session_id long, frame int, {name} int")


def greedy(shots, hits):
    pairs = sorted((abs(s - h), i, j) for i, s in enumerate(shots) for j, h in enumerate(hits) if abs(s - h) <= 2)
    left, right, out = set(), set(), []
    for _, i, j in pairs:
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.append((i, j))
    return sorted(out)


def test_greedy_matches_against_brute_force(spark):
    rnd = random.Random(0)
    shots = {s: sorted(rnd.randrange(40) for _ in range(rnd.randint(0, 15))) for s in range(150)}
    hits = {s: sorted(rnd.randrange(40) for _ in range(rnd.randint(0, 12))) for s in range(150)}
    got = compose.greedy_matches(compose.band_pairs(stream(spark, shots, "si"), stream(spark, hits, "hi"))).collect()
    for s in range(150):
        assert sorted((r["si"], r["hi"]) for r in got if r["session_id"] == s) == greedy(shots[s], hits[s])


def test_whiffs(spark):
    ten = list(range(10, 30, 2))
    shots = {0: [10, 12, 14, 16, 18], 1: [10], **{100 + k: ten for k in range(11)}}
    hits = {0: [14], 1: [12], **{100 + k: ten[:k] for k in range(11)}}
    got = compose.derive_events(stream(spark, shots, "si"), stream(spark, hits, "hi")).filter("type = 'whiff'").collect()
    whiffs = lambda s: sorted(r["frame"] for r in got if r["session_id"] == s)
    assert whiffs(0) == [10, 12, 16, 18] and whiffs(1) == []
    assert [len(whiffs(100 + k)) for k in range(11)] == [10 - k for k in range(11)]


def test_asof_is_inclusive(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 11), (2, 3)], "session_id long, t long")
    right = spark.createDataFrame([(1, 6, "a"), (1, 10, "b"), (2, 4, "c")], "session_id long, t long, v string")
    got = {(r["session_id"], r["t"]): r["v"] for r in compose.asof_backward(left, right, ["session_id"], "t", "v").collect()}
    assert got == {(1, 5): None, (1, 10): "b", (1, 11): "b", (2, 3): None}


@pytest.mark.parametrize(("anchor", "n", "want"), [(0, 1000, (0, 180)), (118, 1000, (0, 180)), (500, 1000, (382, 562)), (999, 1000, (820, 1000)), (5, 100, (0, 100)), (3, 180, (0, 180))])
def test_clip_window(spark, anchor, n, want):
    row = spark.range(1).select(compose.clip_window(F.lit(anchor), F.lit(n)).alias("w")).first()["w"]
    assert (row["lo"], row["hi"]) == want


def test_engagements_split_above_the_gap_and_merge_windows(spark):
    events = spark.createDataFrame([(0, f, "shot") for f in (10, 58, 107)] + [(0, 100, "target_spawn"), (0, 60, "hit")], "session_id long, frame int, type string")
    lengths = spark.createDataFrame([(0, 150)], "session_id long, n int")
    groups = compose.engagements(events, lengths)
    got = sorted((r["group_no"], r["lo"], r["hi"], r["n_shots"], r["n_hits"], r["first_shot"], r["last_spawn"]) for r in groups.collect())
    assert got == [(0, 0, 150, 3, 1, 10, None)]  # steps of 48, 2, 40 and 7 frames: none above the gap
    apart = events.withColumn("frame", F.when(F.col("frame") == 10, 8).otherwise(F.col("frame")))
    groups = compose.engagements(apart, lengths)
    assert groups.count() == 2
    merged = compose.merge_windows(groups).collect()
    assert len(merged) == 1 and merged[0]["n_shots"] == 1 and merged[0]["first_shot"] == 8
    assert merged[0]["type_set"] == ["shot"] and merged[0]["all_types"] == ["hit", "shot", "target_spawn"]


def test_labels(spark):
    cases = [(["kill", "whiff"], "kill", "kill"), (["whiff"], "whiff", "tracking_phase"), (["hit"], "clean_rep", "tracking_phase"), (["death", "kill", "whiff"], "whiff_then_death", "kill")]
    for types, hit, blind in cases:
        t = F.array(*map(F.lit, types))
        assert tuple(spark.range(1).select(compose.event_label(t), compose.event_label(t, False)).first()) == (hit, blind)


def candidates(spark, rows):
    full = [(0, i, rt, over, jit, eff, -2.0, 5, 1, "whiff") for i, (rt, over, jit, eff) in enumerate(rows)]
    df = spark.createDataFrame(full, "session_id long, idx int, reaction_time_ms double, overshoot_count int, jitter_ratio double, path_efficiency double, smoothness_sparc double, shots_fired int, shots_hit int, event_type string")
    return select.coachability(df).withColumn("features", select.review_features())


def picks(df, k):
    return [r["idx"] for r in sorted(select.diverse_top_k(df, k).collect(), key=lambda r: r["pick"])]


def test_selection(spark):
    rnd = random.Random(2)
    many = candidates(spark, [(rnd.uniform(150, 500), rnd.randint(0, 5), rnd.random() / 3, rnd.random()) for _ in range(40)])
    assert len(set(picks(many, 8))) == 8 and len(set(picks(many, 3))) == 3 and picks(many, 0) == []
    assert len(picks(candidates(spark, [(200.0, 1, 0.1, 0.9)] * 2), 8)) == 2
    mixed = candidates(spark, [(400.0, 5, 0.4, 0.5)] * 9 + [(180.0, 0, 0.05, 0.9), (300.0, 2, 0.22, 0.8)])
    assert set(picks(mixed, 4)) & {9, 10}
    bad = candidates(spark, [(400.0 + i, 5, 0.4, 0.5) for i in range(6)] + [(200.0, 0, 0.02, 0.98)])
    assert 6 in picks(bad, 4)
    odd = select.coachability(candidates(spark, [(rt, 0, None, 0.9) for rt in (200.0, 205.0, 600.0, 198.0)])).orderBy(F.desc("score")).first()
    assert odd["idx"] == 2


def test_nan_counts_as_null_in_scores(spark):
    got = candidates(spark, [(200.0, 0, float("nan"), 0.9), (210.0, 0, 0.2, 0.9), (None, 0, None, None)]).collect()
    assert all(r["score"] == r["score"] and None not in r["features"] for r in got)
