"""Command line: analyze, overlay, profiles, doctor, selftest."""

from __future__ import annotations

import argparse
import importlib.util
import sys
import tempfile

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from frametide.operators import pixels, records, traces
from frametide.plans.recordings import analyze_recordings
from frametide.sources import config, media


def session() -> SparkSession:
    spark = SparkSession.builder.appName("frametide").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def analyze(args) -> int:
    spark = session()
    profile = config.load_profile(spark, args.profile, args.profiles).first()
    found = analyze_recordings(media.read_frames(spark, args.recording), profile, args.fps, clips=args.clips).cache()
    lines = records.to_json(found)
    if args.out:
        lines.write.text(args.out)
    else:
        print("[" + ",\n".join(r["json"] for r in lines.toLocalIterator()) + "]")
    for r in records.summary_lines(found).toLocalIterator():
        print(r["line"], file=sys.stderr)
    for r in records.distinct_warnings(found).toLocalIterator():
        print("  -", r["warning"], file=sys.stderr)
    return 0


def overlay(args) -> int:
    spark = session()
    frames = media.read_frames(spark, args.recording, start_ms=args.start_ms, end_ms=args.start_ms + args.duration_ms)
    middle = frames.orderBy("frame").first()
    trace = traces.speed(traces.to_trace(pixels.motion_estimates(frames), middle["w"], args.fov, args.fps), args.fps)
    turns = [r["i"] for r in traces.reversals(trace).collect()]
    path = trace.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("i", "yaw_deg", "pitch_deg"))).alias("s")).first()["s"]
    clip = spark.createDataFrame([(middle["session_id"], middle["w"], middle["h"], middle["pixels"], [p["yaw_deg"] for p in path], [p["pitch_deg"] for p in path], turns)], "clip_id string, w int, h int, pixels binary, yaw_deg array<double>, pitch_deg array<double>, turns array<int>")
    with open(args.out, "wb") as file:
        file.write(pixels.overlays(clip, args.fov).first()["image"])
    return 0


def profiles(args) -> int:
    print("\n".join(config.available_profiles(args.profiles)))
    return 0


def doctor(args) -> int:
    import pyspark

    print(f"python   {sys.version.split()[0]}\nspark    {pyspark.__version__}")
    for name in ("numpy", "pandas", "pyarrow", "yaml"):
        print(f"{name:<8} {'ok' if importlib.util.find_spec(name) else 'missing'}")
    return 0


def selftest(args) -> int:
    """Renders a view that turns by a known angle and checks that it is measured."""
    spark = session()
    truth = np.array([r["yaw_deg"] for r in media.flick_path(spark, 36, 60.0, 30.0, 0.3).orderBy("i").collect()])
    with tempfile.TemporaryDirectory() as folder:
        np.save(f"{folder}/pan.npy", media.rendered_pan(len(truth), 640, 360, truth, 103.0))
        motion = pixels.motion_estimates(media.read_frames(spark, f"{folder}/*.npy"))
        got = np.array([r["yaw_deg"] for r in traces.to_trace(motion, 640, 103.0, 60.0).orderBy("i").collect()])
        confidence = traces.trace_confidence(motion).first()["confidence"]
    error = float(np.abs(got - truth).max())
    print(f"peak error {error:.3f} deg, confidence {confidence:.2f}")
    return 0 if error < 1.2 and confidence >= 0.8 else 1


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="frametide", description="Event and motion analytics of recordings on Spark.")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda f, *more: [p := sub.add_parser(f.__name__, help=f.__doc__), p.set_defaults(run=f), *[p.add_argument(*a, **k) for a, k in more]]
    shared = (("--profiles",), {"default": "profiles", "help": "folder of profiles"})
    fps = (("--fps",), {"type": float, "default": 60.0})
    add(analyze, (("recording",), {}), (("--profile",), {"required": True}), shared, fps, (("--clips",), {"type": int, "default": 8}), (("--out",), {}))
    add(overlay, (("recording",), {}), (("--start-ms",), {"type": float, "default": 0.0}), (("--duration-ms",), {"type": float, "default": 3000.0}), (("--fov",), {"type": float, "default": 103.0}), fps, (("--out",), {"default": "overlay.png"}))
    add(profiles, shared)
    add(doctor)
    add(selftest)
    args = top.parse_args(argv)
    try:
        return args.run(args)
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
