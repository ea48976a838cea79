"""Nested records of engagements: building, checking, serialising, summarising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frametide.functions.scalars import finite
from frametide.operators.compose import detected_by

SCHEMA_VERSION = "clip_analysis/v1"
REQUIRED = ("primary_weakness", "severity", "confidence", "summary", "evidence", "drill", "not_determinable")
#: A skill tier's expected range of each metric.
BANDS = {
    "reaction_time_ms": (180.0, 250.0),
    "jitter_ratio": (0.05, 0.15),
    "overshoot_count": (0.0, 1.0),
    "crosshair_placement_error_deg": (0.0, 3.0),
    "path_efficiency": (0.85, 1.0),
}

ASSESSED = "struct<ai_status:string,primary_weakness:string,severity:int,confidence:double,summary:string,evidence:array<struct<t_rel_s:double,observation:string>>,drill:struct<name:string,target:string,rationale:string>,not_determinable:array<string>>"


def detectors(types: Column) -> Column:
    """The sorted distinct detectors of a set of event types; manual if there are none."""
    found = F.array_sort(F.array_distinct(F.array_compact(F.transform(types, detected_by))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("manual")))


def skipped_assessment() -> Column:
    """What stands for an assessment that wasn't asked for."""
    fields = {"ai_status": F.lit("skipped"), "evidence": F.array().cast("array<struct<t_rel_s:double,observation:string>>"), "not_determinable": F.array().cast("array<string>")}
    order = ("ai_status", "primary_weakness", "severity", "confidence", "summary", "evidence", "drill", "not_determinable")
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in order]).cast(ASSESSED)


def content_hash(frames: DataFrame, keys: list[str], order: str, data: str, stride: int = 4) -> DataFrame:
    """keys, content_sha256: the digest of every ``stride``-th frame's bytes, in order."""
    numbered = frames.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).filter(F.col("_n") % stride == 0)
    ordered = F.array_sort(F.collect_list(F.struct("_n", F.hex(F.col(data).cast("binary")).alias("b"))))
    return numbered.groupBy(*keys).agg(F.sha2(F.unhex(F.array_join(F.transform(ordered, lambda x: x["b"]), "")), 256).alias("content_sha256"))


def trace_arrays(trace: DataFrame) -> DataFrame:
    """clip_id, trace: a clip's samples as parallel arrays, rounded as they are stored."""
    ordered = trace.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("i", "t_ms", "yaw_deg", "pitch_deg", "speed_dps"))).alias("s"))
    part = lambda c, digits: F.transform(F.col("s"), lambda x: F.round(x[c], digits)).alias(c)
    return ordered.select("clip_id", F.struct(part("t_ms", 1), part("yaw_deg", 3), part("pitch_deg", 3), part("speed_dps", 2)).alias("trace"))


def build_records(clips: DataFrame, *, game: str, fps: float, width: int, height: int) -> DataFrame:
    """One nested record a clip: schema_version, clip_id, session_id, source, event, measured, assessed.

    ``clips`` has a column for each measured value (missing ones are null); null
    stands for what couldn't be measured, NaN never leaves here.
    """
    has = set(clips.columns)
    value = lambda c, kind="double": (F.col(c) if c in has else F.lit(None)).cast(kind)
    number = lambda c: finite(value(c)).alias(c)
    source = F.struct(value("file", "string").alias("file"), F.lit(game).alias("game"), F.floor(F.col("lo") * 1000 / fps).cast("long").alias("start_ms"), F.floor(F.col("hi") * 1000 / fps).cast("long").alias("end_ms"), F.lit(float(fps)).alias("fps"), F.lit(f"{width}x{height}").alias("resolution"), value("content_sha256", "string").alias("content_sha256"))
    event = F.struct(F.col("event_type").alias("type"), F.lit(None).cast("string").alias("weapon"), number("trace_confidence").alias("detection_confidence"), detectors(F.col("type_set")).alias("detected_by"))
    numbers = ("reaction_time_ms", "reaction_time_error_ms", "time_to_first_shot_ms", "headshot_pct", "smoothness_sparc", "jitter_ratio", "peak_angular_error_deg", "crosshair_placement_error_deg", "target_switch_ms", "path_efficiency", "cv_confidence")
    measured = F.struct(*[number(c) for c in numbers], *[F.coalesce(value(c, "int"), F.lit(0)).alias(c) for c in ("shots_fired", "shots_hit", "overshoot_count")], F.array(F.lit(8.0), F.lit(30.0)).alias("jitter_band_hz"), F.lit("horizon_proxy_2d").alias("crosshair_placement_method"), value("cv_warnings", "array<string>").alias("cv_warnings"))
    assessed = F.coalesce(F.col("assessed"), skipped_assessment()) if "assessed" in has else skipped_assessment()
    return clips.select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("clip_id").cast("string").alias("clip_id"), F.col("session_id").cast("string").alias("session_id"), source.alias("source"), event.alias("event"), measured.alias("measured"), assessed.alias("assessed"))


def to_json(records: DataFrame) -> DataFrame:
    """Each record as JSON text, null fields included."""
    return records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("json"))


def missing_fields(payload: Column | str) -> Column:
    """The required fields that an assessment's JSON lacks, sorted; all of them if it isn't an object."""
    c = F.col(payload) if isinstance(payload, str) else payload
    keys = F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    return F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), keys))


def summary_lines(records: DataFrame) -> DataFrame:
    """A record's line of the text summary: clip_id, line."""
    m, s = "measured.", "source."
    rt = F.when(F.col(m + "reaction_time_ms").isNull(), "not measurable").otherwise(F.format_string("%.0f+-%.0fms", m + "reaction_time_ms", m + "reaction_time_error_ms"))
    two = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.format_string("%.2f", c))
    cells = ((F.format_string("%d-%d", s + "start_ms", s + "end_ms"), 16), (F.col("event.type"), 17), (F.col(m + "shots_fired").cast("string"), 7), (rt, 17), (two(m + "smoothness_sparc"), 8), (F.col(m + "overshoot_count").cast("string"), 6))
    return records.select("clip_id", F.concat(*[F.rpad(c, n, " ") for c, n in cells], two(m + "path_efficiency")).alias("line"))


def distinct_warnings(records: DataFrame) -> DataFrame:
    return records.select(F.explode("measured.cv_warnings").alias("warning")).distinct().orderBy("warning")


def overlay_names(clips: DataFrame) -> DataFrame:
    """session_id, clip_id, name: the file of a clip's picture, numbered by start."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("start_ms", "clip_id"))
    return clips.select("session_id", "clip_id", F.format_string("%02d_%ds_%s.png", n, F.floor(F.col("start_ms") / 1000).cast("long"), "event_type").alias("name"))


def band_compare(metrics: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """keys, metric, value, verdict (below, within, above) for each metric that has a band and a value."""
    spark = metrics.sparkSession
    dim = spark.createDataFrame([(m, lo, hi) for m, (lo, hi) in bands.items()], "metric string, lo double, hi double")
    long = metrics.select(*keys, *[F.col(m).cast("double").alias(m) for m in bands if m in metrics.columns]).unpivot(keys, [m for m in bands if m in metrics.columns], "metric", "value")
    verdict = F.when(F.col("value") < F.col("lo"), "below").when(F.col("value") > F.col("hi"), "above").otherwise("within")
    return long.filter("value IS NOT NULL").join(F.broadcast(dim), "metric").select(*keys, "metric", "value", verdict.alias("verdict"))


def recurring_weaknesses(assessed: DataFrame, least: int = 3) -> DataFrame:
    """session_id, primary_weakness, n, severity (mean), weight: those in at least ``least`` clips, by frequency times severity."""
    g = assessed.filter(F.col("primary_weakness").isNotNull()).groupBy("session_id", "primary_weakness").agg(F.count("*").alias("n"), F.avg("severity").alias("severity"))
    return g.filter(F.col("n") >= least).withColumn("weight", F.col("n") * F.col("severity")).orderBy(F.desc("weight"), "session_id", "primary_weakness")
