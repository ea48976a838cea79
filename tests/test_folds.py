import numpy as np
import pytest
from frametide.operators import cost, folds, select, spectral
from pyspark.sql import functions as F


def test_fold_starts_anew_for_each_key_across_batches(spark):
    rows = spark.range(0, 30_000, 1, 6).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"))

    def total():
        seen = 0

        def step(at):
            nonlocal seen
            seen += 1
            return seen, at

        return step

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = folds.ordered_fold(rows, "k", ["at"], ["at"], "n long, again long", total).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 30_000 and all(r["n"] == r["at"] // 3 + 1 and r["again"] == r["at"] for r in got)
    assert folds.ordered_fold(rows.limit(0), "k", ["at"], ["at"], "n long, again long", total).count() == 0


def greedy(rows, k, penalty):
    """The picks of one key, one at a time over all candidates."""
    rows = sorted(rows)
    now = [s for _, s, _ in rows]
    chosen = []
    for _ in range(min(k, len(rows))):
        at = max((i for i in range(len(rows)) if i not in [c for c, _ in chosen]), key=lambda i: (now[i], -i))
        chosen.append((at, now[at]))
        now = [v - penalty * np.exp(-np.sqrt(sum((a - b) ** 2 for a, b in zip(r[2], rows[at][2])))) for v, r in zip(now, rows)]
    calm = min(range(len(rows)), key=lambda i: (rows[i][1], i))
    if chosen and len(chosen) < len(rows) and calm not in [c for c, _ in chosen]:
        chosen[-1] = (calm, rows[calm][1])
    return [(rows[c][0], n + 1, round(s, 9)) for n, (c, s) in enumerate(chosen)]


@pytest.mark.parametrize(("k", "penalty"), [(8, 2.0), (1, 2.0), (3, 0.0), (5, 9.0), (0, 1.0)])
def test_pruned_picks_are_those_of_all_candidates(spark, k, penalty):
    rng = np.random.default_rng(5)
    rows = [(key, int(i), float(rng.integers(0, 40)) / 4, rng.normal(size=3).round(2).tolist()) for key in range(4) for i in range((200, 3, 1, 40)[key])]
    frame = spark.createDataFrame(rows, "session_id long, idx long, score double, features array<double>").repartition(5)
    got = select.diverse_top_k(frame, k, penalty=penalty).collect()
    for key in range(4):
        mine = sorted(((r["idx"], r["pick"], round(r["score"], 9)) for r in got if r["session_id"] == key), key=lambda r: r[1])
        assert mine == (greedy([r[1:] for r in rows if r[0] == key], k, penalty) if k else [])


def test_models_and_keys(spark):
    models = spark.createDataFrame([("a", "clip", "small"), ("a", "synthesis", "large"), ("b", "clip", "other")], "provider string, tier string, model string")
    asked = spark.createDataFrame([(1, "a", None, None), (2, "a", "synthesis", None), (3, "b", None, "mine")], "id long, provider string, tier string, model string")
    assert {r["id"]: r["model"] for r in cost.model_defaults(asked, models).collect()} == {1: "small", 2: "large", 3: "mine"}
    with pytest.raises(Exception, match="unknown provider zzz; expected one of a, b"):
        cost.model_defaults(asked.withColumn("provider", F.lit("zzz")), models).collect()
    keyed = spark.createDataFrame([("a", "k", None), ("b", "k2", 2.0)], "provider string, api_key string, month_usd double")
    got = {r["provider"]: r for r in cost.request_defaults(keyed).collect()}
    assert got["a"]["month_usd"] == cost.MONTH_USD and got["b"]["month_usd"] == 2.0 and got["a"]["burst"] == cost.BURST
    with pytest.raises(Exception, match="no API key configured for [ab]"):
        cost.request_defaults(keyed.withColumn("api_key", F.lit(" "))).collect()

    def probe(provider, key):
        if provider == "b":
            raise ValueError(key)

    assert {r["provider"]: r["valid"] for r in cost.valid_keys(keyed, probe).collect()} == {"a": True, "b": False}


def test_spectra_of_long_and_odd_signals(spark):
    rng = np.random.default_rng(1)
    signals = {0: np.abs(rng.normal(size=5000)), 1: np.zeros(10), 2: np.ones(3), 3: np.array([1.0, np.nan, 2.0, np.inf, 3.0, 2.0, 1.0, 0.5])}
    frame = spark.createDataFrame([(c, i, float(x)) for c, s in signals.items() for i, x in enumerate(s)], "clip_id long, i int, x double").repartition(3)
    got = {r["clip_id"]: r["sparc"] for r in spectral.sparc(frame, 60.0).collect()}
    assert got[1] == got[2] == 0.0 and got[0] < 0

    def direct(x, fs=60.0):  # bin by bin
        n = 2 ** (int(np.ceil(np.log2(len(x)))) + 4)
        k = np.arange(int(n * 10 / fs) + 1)
        m = np.array([abs((x * np.exp(-2j * np.pi * ((q * np.arange(len(x))) % n) / n)).sum()) for q in k])
        m = m / m.max()
        at = np.flatnonzero(m >= 0.05)
        m = m[at[0] : at[-1] + 1]
        return -np.hypot(1 / (len(m) - 1), np.diff(m)).sum()

    assert abs(got[3] - direct(signals[3][np.isfinite(signals[3])])) < 1e-9
    assert abs(spectral.arc_length(signals[0][:300], 60.0, 10.0, 0.05, 4) - direct(signals[0][:300])) < 1e-9
    assert spectral.jitter_ratio(frame, 12.0).filter("clip_id = 0").first()["jitter_ratio"] is None
