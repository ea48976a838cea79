"""Detectors: from readings by frame to discrete events.

Inputs are keyed by session_id and ordered by frame; each detector is a window
over its session, or, where state depends on what was emitted before, an ordered
fold over the session's rows.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frametide.functions.scalars import hamming
from frametide.operators.folds import ordered_fold

MAX_STEP = 3
HIT_SCORE = 0.80
EMPTY_STD = 6.0
UNIFORMITY = 0.70
MODE_REACH = 12
MATCH_BITS = 6
PERSISTENCE = 4
HISTORY = 64
SPAWN_FRAMES = 6


def by_session(*order: str) -> Window:
    return Window.partitionBy("session_id").orderBy(*(order or ("frame",)))


def counter_decrements(readings: DataFrame, max_step: int = MAX_STEP) -> DataFrame:
    """Shots from a counter: session_id, frame, nth. A fall of 1 to ``max_step`` between readable values gives one row for each unit; a null value holds the state."""
    steps = readings.filter(F.col("value").isNotNull()).withColumn("step", F.lag("value").over(by_session()) - F.col("value"))
    fired = steps.filter(F.col("step").between(1, max_step))
    return fired.select("session_id", "frame", F.explode(F.sequence(F.lit(1), F.col("step").cast("int"))).alias("nth"))


def rising_edges(scores: DataFrame, threshold: float = HIT_SCORE) -> DataFrame:
    """Hits: session_id, frame, score, where the score reaches the threshold anew. Null scores are skipped without ending a hit."""
    seen = scores.filter(F.col("score").isNotNull()).withColumn("on", F.col("score") >= threshold)
    was = F.coalesce(F.lag("on").over(by_session()), F.lit(False))
    return seen.withColumn("was", was).filter(F.col("on") & ~F.col("was")).select("session_id", "frame", "score")


def filled_rows(rows: DataFrame, std: float = EMPTY_STD, uniformity: float = UNIFORMITY) -> DataFrame:
    """Feed rows that hold text: std and uniformity at or above their bounds; slot is the place among those left."""
    kept = rows.filter((F.col("std") >= std) & (F.col("uniformity") >= uniformity))
    return kept.withColumn("slot", F.row_number().over(Window.partitionBy("session_id", "frame").orderBy("row")) - 1)


def background_uniformity(pixels: DataFrame, keys: list[str], value: str, reach: int = MODE_REACH) -> DataFrame:
    """For each key: the commonest value (the lowest of ties) and the share of values within ``reach`` of it.

    Values are grey levels: a key's histogram is an array of at most 256 bins.
    """
    bins = pixels.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    whole = bins.groupBy(*keys).agg(F.collect_list(F.struct("bin", "n")).alias("h"), F.max_by("bin", F.struct("n", (-F.col("bin")).alias("low"))).alias("mode"), F.sum("n").alias("total"))
    near = F.aggregate("h", F.lit(0).cast("long"), lambda a, b: a + F.when(F.abs(b["bin"] - F.col("mode")) <= reach, b["n"]).otherwise(0))
    return whole.select(*keys, "mode", (near / F.col("total")).alias("uniformity"))


def persistent_hashes(hashes: DataFrame, bits: int = MATCH_BITS, persistence: int = PERSISTENCE) -> DataFrame:
    """Candidates of the feed: session_id, slot, frame (where a run began), confirmed (where it had ``persistence`` frames), hash.

    A run is a slot's hashes in consecutive frames, each within ``bits`` of the
    one before.
    """
    w = Window.partitionBy("session_id", "slot").orderBy("frame")
    same = (F.col("frame") - F.lag("frame").over(w) == 1) & (hamming("hash", F.lag("hash").over(w)) <= bits)
    runs = hashes.withColumn("starts", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("starts").over(w))
    r = Window.partitionBy("session_id", "slot", "run").orderBy("frame")
    numbered = runs.withColumns({"n": F.row_number().over(r), "began": F.first("frame").over(r)})
    return numbered.filter(F.col("n") == persistence).select("session_id", "slot", F.col("began").alias("frame"), F.col("frame").alias("confirmed"), "hash")


def novel_hashes(candidates: DataFrame, key: str, order: list[str], bits: int = MATCH_BITS, history: int = HISTORY) -> DataFrame:
    """Of candidates in order, those further than ``bits`` from each of the last ``history`` kept before. A key's candidates pass one task, as a sorted stream; held are ``history`` hashes."""

    def keep():
        seen: deque[int] = deque(maxlen=history)

        def step(h: int) -> tuple:
            h &= (1 << 64) - 1
            new = all((h ^ s).bit_count() > bits for s in seen)
            if new:
                seen.append(h)
            return (new,)

        return step

    return ordered_fold(candidates, key, order, ["hash"], "_new boolean", keep).filter("_new").drop("_new")


def feed_kills(hashes: DataFrame, bits: int = MATCH_BITS, persistence: int = PERSISTENCE, history: int = HISTORY) -> DataFrame:
    """Kills: a feed row that persists and isn't a recent one moved to another slot; session_id, frame, slot, hash."""
    runs = persistent_hashes(hashes, bits, persistence)
    return novel_hashes(runs, "session_id", ["confirmed", "slot"], bits, history).select("session_id", "frame", "slot", "hash")


def target_spawns(counts: DataFrame, hold: int = SPAWN_FRAMES) -> DataFrame:
    """Spawns: session_id, frame, n_targets, where a count above the confirmed one holds for ``hold`` frames.

    The confirmed count falls with the count; the last full window isn't used.
    A session with more than one spawn in ``2 * hold`` frames has none at all:
    its counts are noise.
    """
    whole = Window.partitionBy("session_id")
    ahead = counts.withColumn("low", F.min("n_targets").over(by_session().rowsBetween(0, hold - 1)))
    ahead = ahead.withColumns({"n": F.count("*").over(whole), "left": F.count("*").over(whole) - F.row_number().over(by_session())})

    def session():
        confirmed = 0

        def step(count: int, low: int, left: int) -> tuple:
            nonlocal confirmed
            rises = left >= hold and count > confirmed and low >= count
            if left >= hold and (rises or count < confirmed):
                confirmed = count
            return (rises,)

        return step

    found = ordered_fold(ahead, "session_id", ["frame"], ["n_targets", "low", "left"], "rises boolean", session).filter("rises")
    plausible = F.count("*").over(whole) <= F.floor(F.floor(F.col("n") / hold) / 2)
    return found.withColumn("plausible", plausible).filter("plausible").select("session_id", "frame", "n_targets")


def keyed_components(points: DataFrame, keys: list[str], low: dict[str, float], high: dict[str, float], min_area: int) -> DataFrame:
    """Points whose every channel lies in its bounds, by component: area and centroid, the largest first."""
    inside = None
    for c in low:
        test = F.col(c).between(low[c], high[c])
        inside = test if inside is None else inside & test
    found = points.filter(inside).groupBy(*keys).agg(F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return found.filter(F.col("area") >= min_area).orderBy(F.desc("area"), *keys)


def classify_by_template(samples: DataFrame, templates: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """The template of highest Pearson correlation for each sample, the lowest label of ties: key, label, confidence.

    ``templates`` is small by contract (one row a label) and broadcast.
    """

    def centred(c: Column) -> Column:
        mean = F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
        return F.transform(c, lambda x: x - mean)

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    ready = lambda df, name: df.withColumn(name, centred(F.col(name).cast("array<double>"))).withColumn(f"{name}_n", F.sqrt(dot(F.col(name), F.col(name))))
    left = ready(samples.select(key, vector), vector)
    right = ready(templates.select(F.col(label), F.col(vector).alias("_t")), "_t")
    scale = F.col(f"{vector}_n") * F.col("_t_n")
    scored = left.crossJoin(F.broadcast(right)).withColumn("r", F.when(scale > 0, dot(F.col(vector), F.col("_t")) / scale).otherwise(0.0))
    best = F.max_by(F.struct(label, "r"), F.struct("r", (-F.col(label)).alias("low")))
    return scored.groupBy(key).agg(best.alias("b")).select(key, F.col(f"b.{label}").alias(label), F.col("b.r").alias("confidence"))


def read_digits(glyphs: DataFrame, keys: list[str], min_confidence: float = 0.45) -> DataFrame:
    """Digits from left to right as a number, with the mean score; null value if any glyph scores too low or the number isn't a long."""
    ordered = F.array_sort(F.collect_list(F.struct("x", F.col("digit").cast("string").alias("d"))))
    text = F.array_join(F.transform(ordered, lambda g: g["d"]), "")
    return glyphs.groupBy(*keys).agg(F.when(F.min("score") >= min_confidence, text.try_cast("long")).alias("value"), F.avg("score").alias("confidence"))
