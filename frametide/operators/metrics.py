"""Mechanical metrics of a clip's trace.

Traces have clip_id, i, t_ms, yaw_deg, pitch_deg and, where needed, speed_dps;
``shots`` have clip_id and shot_idx.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frametide.functions.scalars import clip
from frametide.operators.traces import by_clip

WINDOW_MS = 600.0
QUIET_DPS = 20.0
NOISE_SHARE = 0.08
SETTLED_DPS = 15.0
SETTLED_RUN = 3


def path_efficiency(trace: DataFrame, shots: DataFrame | None = None) -> DataFrame:
    """clip_id, path_efficiency: straight distance over distance travelled, in [0, 1], from the first sample to the shot (or the end); 0 if nothing moved."""
    if shots is not None:
        trace = trace.join(shots, "clip_id").filter(F.col("i") <= F.col("shot_idx"))
    w = by_clip()
    step = F.hypot(F.col("yaw_deg") - F.lag("yaw_deg").over(w), F.col("pitch_deg") - F.lag("pitch_deg").over(w))
    ends = trace.withColumn("step", step).groupBy("clip_id").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("travelled"), F.min_by(F.struct("yaw_deg", "pitch_deg"), "i").alias("a"), F.max_by(F.struct("yaw_deg", "pitch_deg"), "i").alias("b"))
    straight = F.hypot(F.col("b.yaw_deg") - F.col("a.yaw_deg"), F.col("b.pitch_deg") - F.col("a.pitch_deg"))
    return ends.select("clip_id", F.when(F.col("travelled") > 1e-9, clip(straight / F.col("travelled"), 0.0, 1.0)).otherwise(0.0).alias("path_efficiency"))


def placement_and_peak(trace: DataFrame, horizon: float = 0.0) -> DataFrame:
    """clip_id, placement_error_deg (mean distance from the horizon), peak_error_deg (largest yaw)."""
    return trace.groupBy("clip_id").agg(F.avg(F.abs(F.col("pitch_deg") - horizon)).alias("placement_error_deg"), F.max(F.abs("yaw_deg")).alias("peak_error_deg"))


def overshoot_count(trace: DataFrame, shots: DataFrame, fps: float) -> DataFrame:
    """clip_id, overshoot_count: turns of the aim from its last rest to the shot.

    The search goes back at most 600 ms; a tail that has settled before the shot
    is skipped; a rest is ``max(2, 0.15 s)`` of samples under 20 degrees a second.
    Steps under 8 % of the fastest are noise; turns between the others count. A
    shot at the first sample or outside the clip gives 0.
    """
    q = max(2, int(0.15 * fps))
    per = Window.partitionBy("clip_id")
    w = by_clip()
    n = trace.groupBy("clip_id").agg(F.count("*").alias("n"))
    usable = shots.join(n, "clip_id").filter("shot_idx > 0 AND shot_idx < n")
    rows = trace.join(usable, "clip_id").filter(F.col("i") <= F.col("shot_idx"))
    rows = rows.withColumns({"t_shot": F.max_by("t_ms", "i").over(per), "quiet": F.col("speed_dps") < QUIET_DPS})
    back = F.max(F.when((F.col("i") == 0) | (F.col("t_shot") - F.col("t_ms") >= WINDOW_MS), F.col("i"))).over(per)
    rows = rows.withColumn("b", back)
    rows = rows.withColumn("m", F.max(F.when(~F.col("quiet") | (F.col("i") <= F.col("b")), F.col("i"))).over(per))
    # The quiet samples from i on: up to the next one that isn't.
    next_loud = F.min(F.when(~F.col("quiet"), F.col("i"))).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("quiet_until", F.least(F.coalesce(next_loud - 1, F.col("shot_idx")), F.col("m")))
    rest = (F.col("i") > F.col("b")) & (F.col("i") <= F.col("m")) & (F.col("quiet_until") - F.col("i") + 1 >= q)
    rows = rows.withColumn("r", F.coalesce(F.max(F.when(rest, F.col("i"))).over(per), F.col("b")))
    inside = rows.filter(F.col("i") >= F.col("r")).withColumn("v", F.col("yaw_deg") - F.lag("yaw_deg").over(w)).withColumn("size", F.count("*").over(per))
    fast = inside.filter("size >= 3 AND v IS NOT NULL").withColumn("top", F.max(F.abs("v")).over(per)).filter(F.abs("v") > F.col("top") * NOISE_SHARE)
    turns = fast.withColumn("turn", (F.signum("v") != F.signum(F.lag("v").over(w))).cast("int")).groupBy("clip_id").agg(F.coalesce(F.sum("turn"), F.lit(0)).alias("c"))
    return shots.join(turns, "clip_id", "left").select("clip_id", F.coalesce("c", F.lit(0)).cast("int").alias("overshoot_count"))


def target_switch_ms(trace: DataFrame, shots: DataFrame, threshold: float = SETTLED_DPS) -> DataFrame:
    """clip_id, target_switch_ms: from the shot to the start of the first three samples under ``threshold``; null if there are none."""
    w = by_clip()
    slow = F.sum((F.col("speed_dps") < threshold).cast("int")).over(w.rowsBetween(0, SETTLED_RUN - 1))
    runs = trace.withColumns({"slow": slow, "n": F.count("*").over(Window.partitionBy("clip_id"))}).join(shots, "clip_id")
    t_from = F.max(F.when(F.col("i") == F.col("shot_idx"), F.col("t_ms")))
    t_run = F.min(F.when((F.col("i") > F.col("shot_idx")) & (F.col("slow") == SETTLED_RUN) & (F.col("shot_idx") < F.col("n") - SETTLED_RUN), F.col("t_ms")))
    found = runs.groupBy("clip_id").agg((t_run - t_from).alias("target_switch_ms"))
    return shots.select("clip_id").join(found, "clip_id", "left")


def headshot_share(headshots: Column | str | None, hits: Column | str) -> Column:
    """Headshots as a share of hits, 0 where none are counted; null without a hit."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    counted = F.coalesce(c(headshots), F.lit(0)) if headshots is not None else F.lit(0)
    return F.when(c(hits) > 0, counted / c(hits).cast("double"))


def warnings(fps: float, has_stimulus: Column, shots: Column, jitter: Column, hit_detection: bool) -> Column:
    """The notes that go with a clip's numbers, in order."""
    # The notes' wording, which consumers of the records match on.
    stim = has_stimulus & (shots > 0)
    out = [
        F.when(stim & F.lit(fps < 50), F.lit(f"fps={fps:.0f} too low for reaction time; quantization +/-{1000.0 / fps / 2:.1f}ms exceeds useful resolution")),
        F.when(stim & F.lit(fps >= 50), F.lit(f"fps={fps:.0f} limits reaction_time resolution to +/-{1000.0 / fps:.1f}ms")),
        F.when(jitter.isNull(), F.lit(f"fps={fps:.0f} cannot resolve the 8Hz jitter band (Nyquist {fps / 2:.0f}Hz)")),
        F.when((shots > 0) & ~has_stimulus, F.lit("reaction_time unavailable: no stimulus onset detected (needs target-spawn detection or an enemy detector)")),
        F.when((shots > 0) & F.lit(not hit_detection), F.lit("hit detection not configured: shots_hit is not a measurement and whiffs cannot be derived")),
    ]
    return F.array_compact(F.array(*out))


def cv_confidence(fps: float, has_stimulus: Column, shots: Column, jitter: Column) -> Column:
    less = F.when(has_stimulus & (shots > 0) & F.lit(fps < 50), 0.25).otherwise(0.0) + F.when(jitter.isNull(), 0.2).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.lit(1.0) - less), 2)
