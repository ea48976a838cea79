import random

import pytest
from frametide.operators import detect

COUNTERS = [
    ([30, 30, 29, 28, 27, 27, 26, 25, 25], [2, 3, 4, 6, 7]),
    ([8, 7, 6, 30, 30, 29], [1, 2, 5]),
    ([30, 30, 4, 4, 3], [4]),
    ([5, None, 4, None, None, 1], [2, 5, 5, 5]),
    ([None, None], []),
    ([], []),
]


def readings(spark, sequences, name, kind="int"):
    rows = [(s, f, v) for s, seq in enumerate(sequences) for f, v in enumerate(seq)]
    return spark.createDataFrame(rows, f"session_id long, frame int, {name} {kind}")


def frames_of(df, session):
    return sorted(r["frame"] for r in df.collect() if r["session_id"] == session)


def test_counter_decrements(spark):
    got = detect.counter_decrements(readings(spark, [c for c, _ in COUNTERS], "value"))
    for s, (_, want) in enumerate(COUNTERS):
        assert frames_of(got, s) == want


def test_rising_edges(spark):
    lit = lambda n, on: [0.9 if i in on else 0.2 for i in range(n)]
    held = [0.9, None, None, 0.9, 0.1, 0.80]
    got = detect.rising_edges(readings(spark, [lit(12, range(3, 7)), lit(20, (2, 3, 12, 13)), held], "score", "double"))
    assert [frames_of(got, s) for s in range(3)] == [[3], [2, 12], [0, 5]]


def feed(spark, frames):
    rows = [(0, f, slot, h) for f, hashes in enumerate(frames) for slot, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "session_id long, frame int, slot int, hash long")


A, B = 0x0123456789ABCDEF, -0x0123456789ABCDF0


@pytest.mark.parametrize(
    ("frames", "want"),
    [([[A]] * 120, [0]), ([[]] * 30 + [[A]] * 40, [30]), ([[A]] * 40 + [[B, A]] * 40, [0, 40]), ([[A]] * 3 + [[]] * 3, []), ([[A ^ (1 << (i % 3))] for i in range(20)], [0])],
)
def test_feed_kills(spark, frames, want):
    assert frames_of(detect.feed_kills(feed(spark, frames)), 0) == want


def feed_machine(frames, bits=6, persistence=4, history=64):
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() > bits
    pending, seen, out = {}, [], []
    for f, hashes in enumerate(frames):
        now = {}
        for slot, h in enumerate(hashes):
            old = pending.get(slot)
            first, n = (old[1], old[2] + 1) if old and not far(old[0], h) else (f, 1)
            now[slot] = (h, first, n)
            if n == persistence and all(far(h, s) for s in seen):
                seen = [*seen, h][-history:]
                out.append(first)
        pending = now
    return sorted(out)


def test_feed_kills_against_a_state_machine(spark):
    rnd = random.Random(3)
    pool = [rnd.getrandbits(63) for _ in range(6)]
    rows, want = [], {}
    for s in range(40):
        frames, now = [], []
        for _ in range(40):
            if rnd.random() < 0.3:
                now = rnd.sample(pool, rnd.randint(0, 3))
            frames.append([h ^ (1 << rnd.randrange(60)) if rnd.random() < 0.3 else h for h in now])
        want[s] = feed_machine(frames)
        rows += [(s, f, slot, h) for f, hs in enumerate(frames) for slot, h in enumerate(hs)]
    got = detect.feed_kills(spark.createDataFrame(rows, "session_id long, frame int, slot int, hash long"))
    for s in range(40):
        assert frames_of(got, s) == want[s]


def spawns_machine(counts, hold=6):
    confirmed, out = 0, []
    for i in range(len(counts) - hold):
        window = counts[i : i + hold]
        if window[0] > confirmed and min(window) >= window[0]:
            out.append(i)
            confirmed = window[0]
        elif counts[i] < confirmed:
            confirmed = counts[i]
    return [] if len(out) > len(counts) // hold // 2 else out


def test_target_spawns(spark):
    rnd = random.Random(8)
    sequences = [[0] * 10 + [1] * 20, [0] * 40 + [1] * 25 + [2] * 25, [1, 0] * 30, [3] * 6, [3] * 12]
    sequences += [[c for _ in range(12) for c in [rnd.randint(0, 3)] * rnd.randint(1, 9)] for _ in range(30)]
    got = detect.target_spawns(readings(spark, sequences, "n_targets"))
    for s, counts in enumerate(sequences):
        assert frames_of(got, s) == spawns_machine(counts)


def test_background_uniformity_ties_go_low(spark):
    rows = [(1, float(v)) for v in [10] * 3 + [100] * 3 + [20]] + [(2, None)]
    got = detect.background_uniformity(spark.createDataFrame(rows, "k long, v double"), ["k"], "v").collect()
    assert [(r["k"], r["mode"], round(r["uniformity"], 6)) for r in got] == [(1, 10, round(4 / 7, 6))]


def test_novel_hashes_forget(spark):
    rows = [(0, i, h) for i, h in enumerate([0, (1 << 20) - 1, -1, 0])]
    df = spark.createDataFrame(rows, "k long, i int, hash long")
    kept = lambda **o: sorted(r["i"] for r in detect.novel_hashes(df, "k", ["i"], **o).collect())
    assert kept() == [0, 1, 2] and kept(history=1) == [0, 1, 2, 3]


def test_digits_all_or_nothing(spark):
    rows = [(1, 30, 2, 0.9), (1, 10, 4, 0.5), (2, 5, 7, 0.44), (2, 9, 1, 0.9)]
    got = {r["k"]: (r["value"], round(r["confidence"], 3)) for r in detect.read_digits(spark.createDataFrame(rows, "k long, x int, digit int, score double"), ["k"]).collect()}
    assert got == {1: (42, 0.7), 2: (None, 0.67)}
