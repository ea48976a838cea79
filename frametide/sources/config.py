"""Configuration sources: profiles, prices, assessments' cache."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PROFILE = "game string, fov_degrees double, shot_signal string, kill_feed_rows int, feed_row_uniformity double, rois map<string,struct<x:double,y:double,w:double,h:double>>, flow_exclude array<struct<x:double,y:double,w:double,h:double>>, target_hsv struct<lower:array<int>,upper:array<int>>"
#: Endings of recordings, and what a profile may leave out.
VIDEO_SUFFIXES = (".mp4", ".mkv", ".mov", ".avi", ".webm", ".m4v", ".flv", ".wmv")
PROFILE_DEFAULTS = {"shot_signal": "ammo_decrement", "kill_feed_rows": 5, "feed_row_uniformity": 0.70}


def _roi(name: str, box) -> dict[str, float]:
    if len(box) != 4 or any(not 0 <= v <= 1 for v in box) or box[0] + box[2] > 1 + 1e-9 or box[1] + box[3] > 1 + 1e-9:
        raise ValueError(f"region {name}: four numbers in [0, 1] that stay inside the frame are needed, not {box}")
    return dict(zip("xywh", map(float, box)))


def parse_profile(text: str) -> dict:
    """A profile from YAML (or JSON, which is YAML), checked, with defaults; one without a game or a field of view fails."""
    import yaml

    raw = PROFILE_DEFAULTS | yaml.safe_load(text)
    missing = [k for k in ("game", "fov_degrees") if raw.get(k) is None]
    if missing:
        raise ValueError(f"a profile needs {' and '.join(missing)}")
    hsv = raw.get("target_hsv")
    return {
        "game": raw["game"],
        "fov_degrees": float(raw["fov_degrees"]),
        "shot_signal": raw["shot_signal"],
        "kill_feed_rows": int(raw["kill_feed_rows"]),
        "feed_row_uniformity": float(raw["feed_row_uniformity"]),
        "rois": {k: _roi(k, v) for k, v in (raw.get("rois") or {}).items()},
        "flow_exclude": [_roi("flow_exclude", v) for v in raw.get("flow_exclude") or []],
        "target_hsv": {"lower": list(hsv["lower"]), "upper": list(hsv["upper"])} if hsv else None,
    }


def load_profiles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Profiles as a small table, one row a file; any file system that Spark reads."""
    texts = spark.read.text(paths, wholetext=True).collect() if paths else []  # one small file a profile
    return spark.createDataFrame([parse_profile(r["value"]) for r in texts], PROFILE)


def load_profile(spark: SparkSession, name_or_path: str, folder: str) -> DataFrame:
    """A profile by path, or by name in a folder; an unknown name lists what there is."""
    path = Path(name_or_path)
    if not path.exists():
        path = Path(folder) / f"{name_or_path}.yaml"
    if not path.exists():
        raise FileNotFoundError(f"no profile {name_or_path!r}; available: {', '.join(available_profiles(folder))}")
    return load_profiles(spark, [str(path)])


def available_profiles(folder: str) -> list[str]:
    return sorted(p.stem for p in Path(folder).glob("*.yaml"))


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    """model, input, output (USD a million tokens) from a JSON object by model; keys that begin with an underscore are notes; a missing or broken file gives no rows."""
    try:
        raw = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    except Exception:  # a missing file or broken JSON: everything is free, and visibly so
        raw = {}
    rows = [(m, float(p["input"]), float(p["output"])) for m, p in raw.items() if not m.startswith("_")]
    return spark.createDataFrame(rows, "model string, input double, output double")


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """provider, tier, model from a JSON object by provider and tier, for ``cost.model_defaults``; keys that begin with an underscore are notes."""
    raw = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    rows = [(p, t, m) for p, tiers in raw.items() if not p.startswith("_") for t, m in tiers.items()]
    return spark.createDataFrame(rows, "provider string, tier string, model string")


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """key, payload, created_at: the assessments' cache, a Parquet table that grows by appending; read it through ``latest_wins``."""
    return spark.read.schema("key string, payload string, created_at double").parquet(path)


def put_cache(rows: DataFrame, path: str) -> None:
    rows.select("key", "payload", "created_at").write.mode("append").parquet(path)


def looks_like_video(path: str) -> bool:
    return path.lower().endswith(VIDEO_SUFFIXES)
