"""Motion traces: gated accumulation, angles, speed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frametide.functions.scalars import focal_length_px, px_to_deg

MIN_INLIERS, MIN_RATIO, MIN_SPREAD = 24, 0.18, 0.13


def motion_ok() -> Column:
    """Whether a pair's motion estimate can be trusted: enough inliers, in share and in spread."""
    ratio = F.when(F.col("tracked") > 0, F.col("inliers") / F.col("tracked")).otherwise(0.0)
    return (F.col("inliers") >= MIN_INLIERS) & (ratio >= MIN_RATIO) & (F.col("spread") >= MIN_SPREAD)


def by_clip() -> Window:
    return Window.partitionBy("clip_id").orderBy("i")


def accumulate(motion: DataFrame) -> DataFrame:
    """Adds x_px and y_px: displacement so far, where pairs that aren't ok add nothing. Needs clip_id, i, dx, dy, ok."""
    so_far = by_clip().rowsBetween(Window.unboundedPreceding, 0)
    moved = lambda c: F.sum(F.when(F.col("ok"), F.col(c)).otherwise(0.0)).over(so_far)
    return motion.withColumns({"x_px": moved("dx"), "y_px": moved("dy")})


def to_trace(motion: DataFrame, width: int, fov_degrees: float, fps: float) -> DataFrame:
    """clip_id, i, t_ms, yaw_deg, pitch_deg: offsets are added up first and made angles once."""
    focal = focal_length_px(F.lit(width), fov_degrees)
    return accumulate(motion).select("clip_id", "i", (F.col("i") * 1000.0 / fps).alias("t_ms"), px_to_deg("x_px", focal).alias("yaw_deg"), px_to_deg("y_px", focal).alias("pitch_deg"))


def trace_confidence(motion: DataFrame) -> DataFrame:
    """clip_id, confidence: the share of ok pairs among those after the first frame."""
    return motion.filter("i >= 1").groupBy("clip_id").agg(F.avg(F.col("ok").cast("double")).alias("confidence"))


def from_arrays(clips: DataFrame) -> DataFrame:
    """clip_id, i, t_ms, yaw_deg, pitch_deg from a trace stored as arrays. Arrays of unlike or unknown lengths, and fewer than two samples, fail."""
    parts = ("t_ms", "yaw_deg", "pitch_deg")
    n = F.size("t_ms")
    alike = F.coalesce((F.size("yaw_deg") == n) & (F.size("pitch_deg") == n) & F.col("t_ms").isNotNull() & F.col("yaw_deg").isNotNull() & F.col("pitch_deg").isNotNull(), F.lit(False))
    checked = F.when(~alike, F.raise_error(F.lit("trace arrays must share a length"))).when(n < 2, F.raise_error(F.lit("a trace needs at least two samples"))).otherwise(F.arrays_zip(*parts))
    return clips.select("clip_id", F.posexplode(checked).alias("i", "s")).select("clip_id", "i", *[F.col(f"s.{p}").alias(p) for p in parts])


def speed(trace: DataFrame, fps: float) -> DataFrame:
    """Adds speed_dps, degrees a second; the first sample's is 0."""
    w = by_clip()
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.col(c))
    dt = F.coalesce(F.col("t_ms") - F.lag("t_ms").over(w), F.lit(1000.0 / fps)) / 1000.0
    return trace.withColumn("speed_dps", F.hypot(step("yaw_deg"), step("pitch_deg")) / F.greatest(dt, F.lit(1e-9)))


def reversals(trace: DataFrame, quiet_dps: float = 20.0) -> DataFrame:
    """Samples where yaw turns between two adjacent samples that both move: clip_id, i."""
    w = by_clip()
    v = F.col("yaw_deg") - F.lag("yaw_deg").over(w)
    marked = trace.withColumns({"v": v, "moving": F.col("speed_dps") >= quiet_dps})
    turned = (F.signum("v") * F.signum(F.lag("v").over(w)) < 0) & F.col("moving") & F.lag("moving").over(w)
    return marked.withColumn("turned", turned).filter("turned").select("clip_id", "i")
