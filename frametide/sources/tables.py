"""Tables: driver tables, and their columns read as frame streams.

An ``events`` table stands for a recording: a user is a session, an event's place
in time order its frame, and the value its reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, frame (from 0), t_us, event_id, event_type, value."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("session_id"), "event_type", "value")
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    return e.select("session_id", (F.row_number().over(w) - 1).alias("frame"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), "event_id", "event_type", "value")


def counter_readings(spark: SparkSession, sf_dir: str, f: DataFrame | None = None) -> DataFrame:
    """session_id, frame, value, of ``f`` if the frames are at hand."""
    f = frames(spark, sf_dir) if f is None else f
    return f.select("session_id", "frame", F.when(F.col("event_type") != "error", F.floor("value").cast("int") % 31).alias("value"))


def motion(spark: SparkSession, sf_dir: str, f: DataFrame | None = None) -> DataFrame:
    """clip_id, i, dx, dy, ok: steps around 50, errors not trusted."""
    f = frames(spark, sf_dir) if f is None else f
    return f.select(F.col("session_id").alias("clip_id"), F.col("frame").alias("i"), (F.col("value") - 50).alias("dx"), (F.col("value") % 7 - 3).alias("dy"), (F.col("event_type") != "error").alias("ok"))
