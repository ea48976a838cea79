"""From recordings to records: a profile says which detectors run on which regions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frametide.operators import detect, pixels
from frametide.plans import review as plan


def _box(roi) -> tuple[float, float, float, float]:
    return roi["x"], roi["y"], roi["w"], roi["h"]


def analyze_recordings(frames: DataFrame, profile, fps: float = 60.0, *, templates: dict[int, np.ndarray] | None = None, hitmarker: np.ndarray | None = None, clips: int = 8) -> DataFrame:
    """Records of the engagements worth reviewing in each recording.

    ``profile`` is one row of a profile table. Shots need the region ammo and
    digit templates, hits the region crosshair and a marker, spawns a colour
    range (and colour frames), kills the region kill_feed.
    """
    spark = frames.sparkSession
    rois = {name: _box(r) for name, r in profile["rois"].items()}
    none = lambda schema: spark.createDataFrame([], schema)
    shots, hits, extra = none("session_id string, frame int, nth int"), none("session_id string, frame int, score double"), []
    if "ammo" in rois and templates:
        shots = detect.counter_decrements(pixels.counter_readings(frames, rois["ammo"], templates))
    seen = hitmarker is not None and "crosshair" in rois
    if seen:
        hits = detect.rising_edges(pixels.hit_scores(frames, hitmarker, rois["crosshair"]))
    if profile["target_hsv"] is not None:
        counts = pixels.target_counts(frames, list(profile["target_hsv"]["lower"]), list(profile["target_hsv"]["upper"]))
        extra.append(detect.target_spawns(counts).withColumn("type", F.lit("target_spawn")))
    if "kill_feed" in rois:
        rows = pixels.feed_rows(frames, rois["kill_feed"], profile["kill_feed_rows"])
        slots = detect.filled_rows(rows, uniformity=profile["feed_row_uniformity"])
        extra.append(detect.feed_kills(slots.select("session_id", "frame", "slot", "hash")).withColumn("type", F.lit("kill")))
    size = frames.select("w", "h").first()
    s = plan.Settings(fps=fps, width=size["w"], height=size["h"], fov_degrees=profile["fov_degrees"], game=profile["game"], hit_detection=seen, clips=clips)
    lengths = frames.groupBy("session_id").agg(F.count("*").cast("int").alias("n"))
    motion = pixels.motion_estimates(frames, [_box(r) for r in profile["flow_exclude"]])
    return plan.review(plan.all_events(shots, hits, extra), lengths, motion, s)
