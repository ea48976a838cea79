"""Ranking: z-scores, review scores, and a diverse greedy top-k."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLIPS = 8
PENALTY = 2.0


def z_score(value: Column | str, *keys: str) -> Column:
    """Standard score within ``keys`` by the population's deviation; 0 where that is under 1e-9. Null and NaN count as 0."""
    v = F.coalesce(F.nanvl(F.col(value) if isinstance(value, str) else value, F.lit(None)), F.lit(0.0))
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(v).over(w)
    return F.when(sd >= 1e-9, (v - F.avg(v).over(w)) / sd).otherwise(0.0)


def coachability(candidates: DataFrame) -> DataFrame:
    """Adds score: how much a candidate stands out in its session.

    Needs session_id, reaction_time_ms, overshoot_count, jitter_ratio,
    shots_fired, shots_hit, event_type.
    """
    missed = (F.col("shots_fired") - F.col("shots_hit")) / F.greatest(F.lit(1), F.col("shots_fired"))
    score = (
        2.0 * F.abs(z_score(F.col("reaction_time_ms").cast("double"), "session_id"))
        + 1.5 * F.coalesce("overshoot_count", F.lit(0))
        + 1.5 * z_score(F.col("jitter_ratio").cast("double"), "session_id")
        + missed
        + F.when(F.col("event_type") == "whiff_then_death", 1.0).otherwise(0.0)
    )
    return candidates.withColumn("score", score)


def review_features() -> Column:
    """The space in which two candidates are alike: scaled metrics, null as 0."""
    z = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0))
    return F.array(z("reaction_time_ms") / 500, z("overshoot_count"), z("jitter_ratio") * 3, z("path_efficiency"), z("smoothness_sparc") / 3)


def diverse_top_k(candidates: DataFrame, k: int = CLIPS, *, key: str = "session_id", idx: str = "idx", score: str = "score", features: str = "features", penalty: float = PENALTY, clean_rep: bool = True) -> DataFrame:
    """Greedily takes the highest score (the lowest ``idx`` of ties) and takes ``penalty * exp(-distance)`` off all others, ``k`` times.

    If the one of lowest original score isn't taken and any is left, it replaces
    the last pick. Columns: key, idx, pick (order, from 1), score (when picked).
    ``k`` of 0 gives no rows. Each pick depends on all before it, so a key's
    candidates meet in one task, but only those that can be picked do: one further
    below the ``k``-th best score than ``k - 1`` penalties never is.
    """
    order = Window.partitionBy(key).orderBy(F.desc(score), idx)
    best = candidates.select(key, score, idx).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max(1, k))  # cut to k a key before the shuffle
    bound = best.groupBy(key).agg((F.min(score) - max(0, k - 1) * max(0.0, penalty)).alias("_bound"))
    lowest = candidates.groupBy(key).agg(F.min(F.struct(score, idx)).alias("_low"))
    ends = bound.join(lowest, key).select(F.col(key).alias("_key"), "_bound", F.col(f"_low.{idx}").alias("_calmest"))
    near = candidates.select(key, idx, score, features).join(ends, F.col(key).eqNullSafe(F.col("_key")))
    candidates = near.filter(F.col(score).isNull() | (F.col(score) >= F.col("_bound")) | (F.col(idx) == F.col("_calmest")))
    schema = T.StructType([candidates.schema[key], candidates.schema[idx], T.StructField("pick", T.IntegerType()), T.StructField("score", T.DoubleType())])
    names = [f.name for f in schema]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx).reset_index(drop=True)
        first = pdf[score].to_numpy(float)
        now, points = first.copy(), np.array(pdf[features].tolist(), float).reshape(len(pdf), -1)
        free, chosen = np.ones(len(pdf), bool), []
        for _ in range(min(k, len(pdf))):
            at = int(np.argmax(np.where(free, now, -np.inf)))
            chosen.append((at, float(now[at])))
            free[at] = False
            now = now - penalty * np.exp(-np.sqrt(((points - points[at]) ** 2).sum(axis=1)))
        calmest = int(np.argmin(first)) if len(first) else -1
        if clean_rep and chosen and free.any() and free[calmest]:
            chosen[-1] = (calmest, float(first[calmest]))
        return pd.DataFrame([(pdf[key][a], pdf[idx][a], n + 1, s) for n, (a, s) in enumerate(chosen)], columns=names)

    return candidates.select(key, idx, score, features).groupBy(key).applyInPandas(fold, schema)
