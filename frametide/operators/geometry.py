"""Geometry of frames: regions, sample grids, tiles, drawing coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CENTRE_SHARE = 0.15


def outside_regions(points: DataFrame, regions: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points in none of the regions (x0, y0, x1, y1, far edges included). Regions are a handful by contract and broadcast."""
    r = F.broadcast(regions.select("x0", "y0", "x1", "y1"))
    inside = F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1"))
    return points.join(r, inside, "left_anti")


def centre_region(width: Column, height: Column, share: float = CENTRE_SHARE) -> Column:
    """The box around the centre that motion isn't measured in."""
    w, h = F.floor(width * share / 2), F.floor(height * share / 2)
    cx, cy = F.floor(width / 2), F.floor(height / 2)
    return F.struct((cx - w).alias("x0"), (cy - h).alias("y0"), (cx + w).alias("x1"), (cy + h).alias("y1"))


def grid_times(clips: DataFrame, n: int = 9) -> DataFrame:
    """Adds tile and t_ms: the centres of ``n`` equal parts of [start_ms, end_ms]."""
    tiled = clips.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return tiled.withColumn("t_ms", F.col("start_ms") + (F.col("end_ms") - F.col("start_ms")) * (F.col("tile") + 0.5) / n)


def fill_forward(tiles: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """A tile that couldn't be read repeats the last that could."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return tiles.withColumn(value, F.last(value, ignorenulls=True).over(w))


def letterbox(width: Column | str, height: Column | str, size: int) -> Column:
    """A frame fitted into a square: struct of w, h and the left and top padding."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    scale = F.lit(float(size)) / F.greatest(c(width), c(height))
    w, h = F.floor(c(width) * scale).cast("int"), F.floor(c(height) * scale).cast("int")
    return F.struct(w.alias("w"), h.alias("h"), F.floor((size - w) / 2).cast("int").alias("left"), F.floor((size - h) / 2).cast("int").alias("top"))


def sparkline(trace: DataFrame, value: str, height: int) -> DataFrame:
    """Adds y: a clip's values scaled from its least to its greatest onto pixel rows, the greatest on top."""
    w = Window.partitionBy("clip_id")
    low, high = F.min(value).over(w), F.max(value).over(w)
    share = F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0)
    return trace.withColumn("y", F.floor((1 - share) * (height - 1)).cast("int"))


def spread(points: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """keys, spread: the lesser of the points' deviations, relative to the frame; 0 for one point."""
    by = points.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return by.select(*keys, F.when(F.col("n") > 1, F.least(F.col("sx") / width, F.col("sy") / height)).otherwise(0.0).alias("spread"))
