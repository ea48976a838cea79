import numpy as np
import pytest
from frametide.functions import scalars as fn
from frametide.operators import metrics, spectral, traces
from frametide.sources.media import flick_path
from pyspark.sql import functions as F


def min_jerk(t, a, d):
    tau = np.clip(t / d, 0, 1)
    return a * (10 * tau**3 - 15 * tau**4 + 6 * tau**5)


def trace(spark, clips, fps):
    rows = []
    for c, (yaw, pitch) in enumerate(clips):
        pitch = np.zeros(len(yaw)) if pitch is None else pitch
        rows += [(c, i, i * 1000.0 / fps, float(y), float(p)) for i, (y, p) in enumerate(zip(yaw, pitch))]
    return traces.speed(spark.createDataFrame(rows, "clip_id long, i int, t_ms double, yaw_deg double, pitch_deg double"), fps)


def shots(spark, at):
    return spark.createDataFrame(list(enumerate(at)), "clip_id long, shot_idx int")


def values(df, name):
    return {r["clip_id"]: r[name] for r in df.collect()}


def overshoot_backward(yaw, t, speed, shot, fps):
    n, q = len(t), max(2, int(0.15 * fps))
    if shot <= 0 or shot >= n:
        return 0
    quiet = speed < 20
    b = max(i for i in range(shot + 1) if i == 0 or t[shot] - t[i] >= 600)
    m = max(i for i in range(shot + 1) if not quiet[i] or i <= b)
    rest = [i for i in range(b + 1, m + 1) if i + q - 1 <= m and quiet[i : i + q].all()]
    r = max(rest) if rest else b
    y = yaw[r : shot + 1]
    if len(y) < 3:
        return 0
    v = np.diff(y)
    kept = v[np.abs(v) > 0.08 * np.abs(v).max()] if np.abs(v).max() > 0 else v[:0]
    return int((np.sign(kept[1:]) != np.sign(kept[:-1])).sum()) if len(kept) > 1 else 0


def test_overshoot_cases(spark):
    fps = 240.0
    t = np.arange(int(0.6 * fps)) / fps
    corrected = min_jerk(t, 40, 0.15) - min_jerk(t - 0.15, 12, 0.15) + min_jerk(t - 0.3, 4, 0.15)
    direct = min_jerk(t, 40, 0.3)
    n = len(t) - 1
    got = values(metrics.overshoot_count(trace(spark, [(corrected, None), (direct, None), (direct, None)], fps), shots(spark, [n, n, 0]), fps), "overshoot_count")
    assert got == {0: 2, 1: 0, 2: 0}


def test_overshoot_against_backward_scan(spark):
    rng = np.random.default_rng(4)
    fps, clips, at = 60.0, [], []
    for _ in range(80):
        n = int(rng.integers(5, 90))
        step = rng.normal(size=n) * rng.choice([0.05, 0.3, 3.0], size=n)
        clips.append((np.cumsum(step), None))
        at.append(int(rng.integers(0, n + 2)))
    df = trace(spark, clips, fps)
    got = values(metrics.overshoot_count(df, shots(spark, at), fps), "overshoot_count")
    speeds = {}
    for r in df.collect():
        speeds.setdefault(r["clip_id"], {})[r["i"]] = r["speed_dps"]
    for c, (yaw, _) in enumerate(clips):
        n = len(yaw)
        speed = np.array([speeds[c][i] for i in range(n)])
        assert got[c] == overshoot_backward(yaw, np.arange(n) * 1000.0 / fps, speed, at[c], fps), c


def test_path_efficiency(spark):
    back = np.concatenate([np.linspace(0, 40, 50), np.linspace(40, 28, 20), np.linspace(28, 30, 10)])
    got = values(metrics.path_efficiency(trace(spark, [(np.linspace(0, 30, 100), None), (back, None), (np.zeros(10), None)], 60.0)), "path_efficiency")
    assert got[0] == pytest.approx(1, abs=1e-6) and 0.4 < got[1] < 0.75 and got[2] == 0


def test_placement_and_settling(spark):
    fps = 240.0
    t = np.arange(int(0.5 * fps)) / fps
    df = trace(spark, [(min_jerk(t, 60, 0.2), np.full(len(t), -4.0)), (200 * t, None)], fps)
    assert values(metrics.placement_and_peak(df), "placement_error_deg")[0] == pytest.approx(4)
    settle = values(metrics.target_switch_ms(df, shots(spark, [0, 0])), "target_switch_ms")
    assert 190 < settle[0] < 225 and settle[1] is None


def test_reaction_time(spark):
    got = spark.range(1).select(fn.reaction_time(F.lit(100), F.lit(113), 60.0).alias("r")).first()["r"]
    assert got["ms"] == pytest.approx(216.6667, abs=1e-3) and got["error_ms"] == pytest.approx(16.6667, abs=1e-3)
    with pytest.raises(Exception, match="shot before stimulus"):
        spark.range(1).select(fn.reaction_time(F.lit(120), F.lit(100), 60.0)).collect()


def test_geometry(spark):
    f = fn.focal_length_px(F.lit(1280), 103.0)
    row = spark.range(1).select(fn.focal_length_px(F.lit(1920), 90.0), fn.px_to_deg(f, f), fn.deg_to_px(F.lit(45.0), f) - f).first()
    assert row[0] == pytest.approx(960) and row[1] == pytest.approx(45) and row[2] == pytest.approx(0, abs=1e-9)
    with pytest.raises(Exception, match="field of view"):
        spark.range(1).select(fn.focal_length_px(F.lit(1920), 180.0)).collect()


def test_motion_gate(spark):
    rows = [(53, 230, 0.27), (90, 140, 0.06), (23, 30, 0.5), (24, 24, 0.13), (30, 0, 0.5)]
    got = [r[0] for r in spark.createDataFrame(rows, "inliers int, tracked int, spread double").select(traces.motion_ok()).collect()]
    assert got == [True, False, False, True, False]


def test_bad_pairs_hold_position(spark):
    m = spark.createDataFrame([(0, 0, 0.0, 0.0, True), (0, 1, 5.0, 1.0, True), (0, 2, 99.0, 99.0, False), (0, 3, 5.0, 1.0, True)], "clip_id long, i int, dx double, dy double, ok boolean")
    assert [r["x_px"] for r in sorted(traces.accumulate(m).collect(), key=lambda r: r["i"])] == [0, 5, 5, 10]
    assert values(traces.trace_confidence(m), "confidence")[0] == pytest.approx(2 / 3)


def fft_sparc(x, fs, fc=10.0):
    x = x[np.isfinite(x)]
    if len(x) < 4 or not x.any():
        return 0.0
    n = 2 ** (int(np.ceil(np.log2(len(x)))) + 4)
    f, m = np.arange(n) * fs / n, np.abs(np.fft.fft(x, n))
    m = m / m.max()
    f, m = f[f <= fc], m[f <= fc]
    on = np.flatnonzero(m >= 0.05)
    f, m = f[on[0] : on[-1] + 1], m[on[0] : on[-1] + 1]
    if len(f) < 2:
        return 0.0
    return float(-np.hypot(np.diff(f) / (f[-1] - f[0]), np.diff(m)).sum())


def signal(spark, xs):
    return spark.createDataFrame([(c, i, float(v)) for c, x in enumerate(xs) for i, v in enumerate(x)], "clip_id long, i int, x double")


def test_sparc_against_fft(spark):
    rng = np.random.default_rng(1)
    xs = [np.abs(np.gradient(min_jerk(np.arange(120) / 240, a, 0.4))) * 240 for a in (5, 90)] + [np.abs(rng.normal(size=n)) for n in (3, 50, 200)] + [np.zeros(64)]
    xs[3][7] = np.nan
    got = values(spectral.sparc(signal(spark, xs), 240.0), "sparc")
    for c, x in enumerate(xs):
        assert got[c] == pytest.approx(fft_sparc(x, 240.0), abs=1e-9)
    assert abs(got[0] - got[1]) < 0.02 and got[5] == 0


def fft_welch(x, fs, nperseg, noverlap, detrend):
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    out = []
    for a in range(0, len(x) - nperseg + 1, nperseg - noverlap):
        s = x[a : a + nperseg]
        if detrend == "constant":
            s = s - s.mean()
        if detrend == "linear":
            s = s - np.polyval(np.polyfit(np.arange(nperseg), s, 1), np.arange(nperseg))
        p = np.abs(np.fft.rfft(s * w)) ** 2 / (fs * (w**2).sum())
        p[1 : -1 if nperseg % 2 == 0 else None] *= 2
        out.append(p)
    return np.mean(out, axis=0)


@pytest.mark.parametrize("detrend", ["constant", "linear", None])
@pytest.mark.parametrize("nperseg", [16, 33])
def test_welch_against_fft(spark, detrend, nperseg):
    x = np.cumsum(np.random.default_rng(2).normal(size=100))
    got = {r["k"]: r["power"] for r in spectral.welch(signal(spark, [x]), 60.0, nperseg, detrend=detrend).collect()}
    want = fft_welch(x, 60.0, nperseg, nperseg // 2, detrend)
    assert len(got) == len(want) and np.allclose([got[k] for k in range(len(want))], want, rtol=1e-8, atol=1e-12)


def test_welch_arguments(spark):
    with pytest.raises(ValueError):
        spectral.welch(signal(spark, [[1.0]]), 60.0, 16, 16)
    with pytest.raises(ValueError):
        spectral.welch(signal(spark, [[1.0]]), 60.0, 16, detrend="cubic")


def test_jitter(spark):
    t = np.arange(480) / 240
    clean = 8 * np.sin(2 * np.pi * 2 * t)
    shaky = clean + 0.6 * np.sin(2 * np.pi * 15 * t)
    speed = lambda x: np.abs(np.gradient(x)) * 240
    got = values(spectral.jitter_ratio(signal(spark, [speed(clean), speed(shaky), [1.0] * 5]), 240.0), "jitter_ratio")
    assert got[0] < 0.10 and got[1] > 3 * got[0] and got[2] == 0
    assert values(spectral.jitter_ratio(signal(spark, [speed(clean)]), 12.0), "jitter_ratio")[0] is None


def test_hann(spark):
    i = spark.range(8).select(F.col("id").cast("int").alias("i"))
    assert np.allclose([r[0] for r in i.select(fn.hann("i", 8)).collect()], 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(8) / 8))
    assert np.allclose([r[0] for r in i.select(fn.hann("i", 8, False)).collect()], np.hanning(8))
    assert i.select(fn.hann("i", 1)).first()[0] == 1


def test_flick_path(spark):
    got = [r["yaw_deg"] for r in sorted(flick_path(spark, 60, 60.0, 40.0, 0.3, 6.0).collect(), key=lambda r: r["i"])]
    assert max(got) > 45 and got[0] == 0 and got[-1] == pytest.approx(40)


def test_headshots_and_array_traces(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(4, 1), (4, None), (0, 0)], "hits int, heads int")
    assert [r[0] for r in rows.select(metrics.headshot_share("heads", "hits")).collect()] == [0.25, 0.0, None]
    assert [r[0] for r in rows.select(metrics.headshot_share(None, "hits")).collect()] == [0.0, 0.0, None]
    good = spark.createDataFrame([("a", [0.0, 1.0], [2.0, 3.0], [4.0, 5.0])], "clip_id string, t_ms array<double>, yaw_deg array<double>, pitch_deg array<double>")
    assert [tuple(r) for r in traces.from_arrays(good).orderBy("i").collect()] == [("a", 0, 0.0, 2.0, 4.0), ("a", 1, 1.0, 3.0, 5.0)]
    for bad, message in ((good.withColumn("yaw_deg", F.array(F.lit(1.0))), "share a length"), (good.withColumn("yaw_deg", F.lit(None).cast("array<double>")), "share a length"), (good.select("clip_id", *[F.slice(c, 1, 1).alias(c) for c in ("t_ms", "yaw_deg", "pitch_deg")]), "two samples")):
        with pytest.raises(Exception, match=message):
            traces.from_arrays(bad).collect()
