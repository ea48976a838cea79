"""From events to engagements: pairing, grouping, windows, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frametide.operators.folds import ordered_fold

TOLERANCE = 2
GAP_MS = 800
CLIP_MS = 3000
LEAD = 0.66
MIN_FRAMES = 4
DETECTORS = {"shot": "ammo_decrement", "hit": "hitmarker", "whiff": "ammo_decrement", "kill": "killfeed", "target_spawn": "target_color"}


def band_pairs(shots: DataFrame, hits: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Pairs within ``tolerance`` frames: session_id, si, hi, dist. Shots have si, hits have hi, both frame.

    Each hit is repeated once for every frame that it reaches, so the band join is
    a hash join on session and frame and never a nested loop.
    """
    reach = hits.select("session_id", "hi", F.col("frame").alias("hit_frame"), F.explode(F.sequence(F.col("frame") - tolerance, F.col("frame") + tolerance)).alias("frame"))
    return shots.join(reach, ["session_id", "frame"]).select("session_id", "si", "hi", F.abs(F.col("frame") - F.col("hit_frame")).cast("int").alias("dist"))


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """One-to-one matches, nearest pairs first (then lower shot, then lower hit); each shot and each hit is used once.

    A displaced second choice depends on all nearer pairs, so this is an ordered
    fold over a session's pairs, of which a shot has at most a few. Held are the
    numbers of the session's matched shots and hits.
    """

    def session():
        shots, hits = set(), set()

        def step(shot: int, hit: int) -> tuple:
            free = shot not in shots and hit not in hits
            if free:
                shots.add(shot)
                hits.add(hit)
            return (free,)

        return step

    return ordered_fold(pairs, "session_id", ["dist", "si", "hi"], ["si", "hi"], "_free boolean", session).filter("_free").drop("_free")


def whiffs(shots: DataFrame, matches: DataFrame) -> DataFrame:
    """Shots without a matched hit."""
    return shots.join(matches.select("session_id", "si"), ["session_id", "si"], "left_anti")


def derive_events(shots: DataFrame, hits: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Shots, hits and whiffs as one stream: session_id, frame, type. Sort by (frame, type) where order matters."""
    missed = whiffs(shots, greedy_matches(band_pairs(shots, hits, tolerance)))
    named = [(shots, "shot"), (missed, "whiff"), (hits, "hit")]
    parts = [df.select("session_id", "frame", F.lit(kind).alias("type")) for df, kind in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """``left`` with ``value``: the latest of ``right`` at or before ``at``, null if there is none.

    A union and one window; at equal ``at`` the right side counts as earlier.
    """
    cols = left.columns
    rows = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    found = right.select(*keys, at, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    both = rows.unionByName(found, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").select(*cols, value)


def detected_by(kind: Column) -> Column:
    """The detector that emits a type of event."""
    table = F.create_map(*[F.lit(x) for item in DETECTORS.items() for x in item])
    return F.try_element_at(table, kind)


def gap_groups(events: DataFrame, order: str, gap: float | int, tie: list[str] | None = None) -> DataFrame:
    """Numbers a session's groups from 0: a new one begins where the step from the event before exceeds ``gap``."""
    w = Window.partitionBy("session_id").orderBy(order, *(tie or []))
    new = F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("int"), F.lit(0))
    return events.withColumn("_new", new).withColumn("group_no", F.sum("_new").over(w)).drop("_new")


def engagement_gap(fps: float) -> int:
    return max(2, int(GAP_MS / 1000.0 * fps))


def clip_window(anchor: Column, n: Column, fps: float = 60.0) -> Column:
    """Struct of lo and hi: a window of three seconds, two thirds before the anchor, slid into [0, n)."""
    window = int(CLIP_MS / 1000.0 * fps)
    lead = int(window * LEAD)
    lo = F.greatest(F.lit(0), F.least(anchor - lead, n - window))
    whole = n <= window
    return F.struct(F.when(whole, 0).otherwise(lo).cast("int").alias("lo"), F.when(whole, n).otherwise(lo + window).cast("int").alias("hi"))


def engagements(events: DataFrame, lengths: DataFrame, fps: float = 60.0) -> DataFrame:
    """Groups of events with their windows: session_id, group_no, anchor, lo, hi, type_set, n_shots, n_hits, first_shot, last_spawn.

    ``lengths``: session_id and n, its frames. Windows under four frames are
    dropped. Shots and spawns count inside the window, hits anywhere in the
    group. last_spawn is the latest spawn at or before the first shot.
    """
    groups = gap_groups(events, "frame", engagement_gap(fps), ["type"])
    g = groups.groupBy("session_id", "group_no").agg(F.min("frame").alias("anchor"), F.collect_set("type").alias("type_set"), F.collect_list(F.struct("frame", "type")).alias("ev"))
    w = g.join(lengths, "session_id").withColumn("w", clip_window(F.col("anchor"), F.col("n"), fps)).select("*", "w.lo", "w.hi").filter(F.col("hi") - F.col("lo") >= MIN_FRAMES)
    frames = lambda kind: F.transform(F.filter("ev", lambda e: (e["type"] == kind) & (e["frame"] >= F.col("lo")) & (e["frame"] < F.col("hi"))), lambda e: e["frame"])
    w = w.withColumns({"shots": frames("shot"), "spawns": frames("target_spawn"), "n_hits": F.size(F.filter("ev", lambda e: e["type"] == "hit"))})
    w = w.withColumn("first_shot", F.array_min("shots"))
    last = F.array_max(F.filter("spawns", lambda s: s <= F.col("first_shot")))
    return w.select("session_id", "group_no", "anchor", "lo", "hi", F.array_sort("type_set").alias("type_set"), F.size("shots").alias("n_shots"), "n_hits", "first_shot", last.alias("last_spawn"))


def merge_windows(groups: DataFrame) -> DataFrame:
    """One row for each distinct window: the first group's values, with the types of all."""
    first = [c for c in groups.columns if c not in ("session_id", "lo", "hi", "type_set")]
    merged = groups.groupBy("session_id", "lo", "hi").agg(F.min_by(F.struct(*first), "group_no").alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("type_set")))).alias("all_types"), F.min_by("type_set", "group_no").alias("type_set"))
    return merged.select("session_id", "lo", "hi", "f.*", "type_set", "all_types")


def event_label(types: Column, hit_detection: bool = True) -> Column:
    """What an engagement is called after the types of its events."""
    has = lambda t: F.array_contains(types, t)
    if not hit_detection:
        return F.when(has("kill"), "kill").otherwise("tracking_phase")
    return F.when(has("whiff") & has("death"), "whiff_then_death").when(has("kill"), "kill").when(has("whiff"), "whiff").otherwise("clean_rep")
