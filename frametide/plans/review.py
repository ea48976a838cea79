"""The whole way from readings to ranked records, as one plan.

Detect, pair, group, window, measure, label, score, rank, record. Everything is
keyed by session; the only rows that meet are those of one session.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frametide.operators import compose, metrics, records, select, spectral, traces
from frametide.sources.scratch import written


@dataclass(frozen=True)
class Settings:
    """What a profile and a recording say: rate, picture width, view, and whether hits are detected."""

    fps: float = 60.0
    width: int = 1920
    height: int = 1080
    fov_degrees: float = 103.0
    game: str = "trainer"
    hit_detection: bool = True
    clips: int = select.CLIPS


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("session_id").orderBy(*order)) - 1)


def all_events(shots: DataFrame, hits: DataFrame, extra: list[DataFrame]) -> DataFrame:
    """Derived shots, hits and whiffs with further event streams: session_id, frame, type.

    Shots and hits are few beside the readings they come from and are read three
    times here: they are written once.
    """
    out = compose.derive_events(written(numbered(shots, "si", "frame", "nth"), "shots"), written(numbered(hits, "hi", "frame"), "hits"))
    for more in extra:
        out = out.unionByName(more.select("session_id", "frame", "type"))
    return out


def measure(groups: DataFrame, motion: DataFrame, s: Settings) -> DataFrame:
    """Engagements with every metric of their window's trace. ``motion``: clip_id (the session), i (the frame), dx, dy, ok.

    A window's trace starts anew at its first frame: offsets are accumulated
    inside the window only. Headshots are counted if ``groups`` has n_headshots. Seven metrics read the trace: it is written once.
    """
    keyed = written(groups.withColumn("key", F.concat_ws(":", F.col("session_id").cast("string"), "lo")), "groups")
    cut = motion.withColumnRenamed("clip_id", "session_id").join(keyed.select("session_id", "key", "lo", "hi"), "session_id").filter((F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi")))
    zero = lambda c: F.when(F.col("i") > F.col("lo"), F.col(c)).otherwise(0.0).alias(c)
    clips = cut.select(F.col("key").alias("clip_id"), (F.col("i") - F.col("lo")).alias("i"), zero("dx"), zero("dy"), "ok")
    clips = written(clips, "clips")
    trace = written(traces.speed(traces.to_trace(clips, s.width, s.fov_degrees, s.fps), s.fps), "trace")
    size = F.col("hi") - F.col("lo")
    shots = keyed.select(F.col("key").alias("clip_id"), F.coalesce(F.col("first_shot") - F.col("lo"), size - 1).alias("shot_idx"))
    signal = trace.select("clip_id", "i", F.col("speed_dps").alias("x"))
    out = keyed.withColumnRenamed("key", "clip_id")
    for part in (
        traces.trace_confidence(clips).withColumnRenamed("confidence", "trace_confidence"),
        metrics.path_efficiency(trace, shots),
        metrics.placement_and_peak(trace).select("clip_id", F.col("placement_error_deg").alias("crosshair_placement_error_deg"), F.col("peak_error_deg").alias("peak_angular_error_deg")),
        metrics.overshoot_count(trace, shots, s.fps),
        metrics.target_switch_ms(trace, shots),
        spectral.sparc(signal, s.fps).withColumnRenamed("sparc", "smoothness_sparc"),
        spectral.jitter_ratio(signal, s.fps),
    ):
        out = out.join(part, "clip_id", "left")
    stim = F.col("last_spawn").isNotNull()
    reaction = F.when(F.lit(s.fps >= 50) & stim & F.col("first_shot").isNotNull(), (F.col("first_shot") - F.col("last_spawn")) * 1000.0 / s.fps)
    jitter, shots_n = F.col("jitter_ratio"), F.col("n_shots")
    return out.withColumns({
        "reaction_time_ms": reaction,
        "reaction_time_error_ms": F.when(reaction.isNotNull(), F.lit(1000.0 / s.fps)),
        "time_to_first_shot_ms": reaction,
        "headshot_pct": metrics.headshot_share("n_headshots" if "n_headshots" in out.columns else None, "n_hits"),
        "shots_fired": shots_n,
        "shots_hit": F.col("n_hits"),
        "cv_warnings": metrics.warnings(s.fps, stim, shots_n, jitter, s.hit_detection),
        "cv_confidence": metrics.cv_confidence(s.fps, stim, shots_n, jitter),
        "event_type": compose.event_label(F.col("type_set"), s.hit_detection),
    })


def candidates(events: DataFrame, lengths: DataFrame, motion: DataFrame, s: Settings) -> DataFrame:
    """Every engagement, measured, labelled and scored."""
    groups = compose.merge_windows(compose.engagements(events, lengths, s.fps))
    scored = written(select.coachability(measure(groups, motion, s)), "scored")
    return numbered(scored, "idx", "lo", "hi").withColumn("features", select.review_features())


def review(events: DataFrame, lengths: DataFrame, motion: DataFrame, s: Settings) -> DataFrame:
    """The records of each session's engagements that are worth reviewing."""
    found = candidates(events, lengths, motion, s)
    picked = select.diverse_top_k(found, s.clips)
    chosen = found.drop("score").join(picked, ["session_id", "idx"]).withColumn("type_set", F.col("all_types"))
    return records.build_records(chosen, game=s.game, fps=s.fps, width=s.width, height=s.height)
