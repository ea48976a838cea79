"""Recordings: files of raw frames, decoded by a function that the caller supplies or by NumPy's own format."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from frametide.functions.scalars import min_jerk
from frametide.operators.pixels import put, written_text

FRAMES = "session_id string, frame int, t_ms double, w int, h int, pixels binary"
PAIRS = FRAMES + ", before binary"
DEFAULT_FPS = 60.0

Decoder = Callable[[bytes], tuple[float, Iterator[np.ndarray]]]


def npy_decoder(data: bytes) -> tuple[float, Iterator[np.ndarray]]:
    """An array of frames (n, h, w) or (n, h, w, 3) as NumPy saves it; its rate is unknown."""
    return 0.0, iter(np.load(io.BytesIO(data), allow_pickle=False))


def read_frames(spark: SparkSession, path: str, decoder: Decoder = npy_decoder, *, start_ms: float | None = None, end_ms: float | None = None, pairs: bool = False) -> DataFrame:
    """All frames of the recordings under ``path``, or those between two times, both included.

    A file is a session and one task; its frames leave it one batch at a time,
    each with the frame before it if ``pairs`` (null for the first read). A rate
    of 0 counts as 60; a recording under two frames fails. A file is read whole,
    so it has to be under 2 GB: for longer ones see :class:`RawFrames`.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in (PAIRS if pairs else FRAMES).split(", ")]
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                fps, images = decoder(data)
                fps, seen, out, last = fps or DEFAULT_FPS, 0, [], None
                for i, image in enumerate(images):
                    t = i * 1000.0 / fps
                    seen += 1
                    if (start_ms is None or t >= start_ms) and (end_ms is None or t <= end_ms):
                        now = np.ascontiguousarray(image, np.uint8).tobytes()
                        out.append((name, i, t, image.shape[1], image.shape[0], now, *([last] if pairs else [])))
                        last = now
                    if len(out) == 64:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                if seen < 2:
                    raise ValueError(f"{name}: a recording needs two frames")
                yield pd.DataFrame(out, columns=names)

    return files.mapInPandas(run, PAIRS if pairs else FRAMES)


class RawFrames(DataSource):
    """``spark.read.format("raw_frames")``: long recordings of raw frames in NumPy's format, read by parts.

    Options: paths (comma-separated, on a file system that all executors mount),
    fps, start_ms and end_ms (both included) and chunk_frames. A part is a range
    of one file's frames and a task of its own; it seeks to its first frame, so
    neither a time range nor a part reads more than its frames and the one before.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return PAIRS

    def reader(self, schema) -> DataSourceReader:
        return _RawReader(dict(self.options))


class _Part(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class _RawReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options["paths"].split(",") if p]
        self.fps = float(options.get("fps", 0)) or DEFAULT_FPS
        self.start, self.end = (float(options[k]) if k in options else None for k in ("start_ms", "end_ms"))
        self.chunk = int(options.get("chunk_frames", 600))

    def partitions(self) -> list[_Part]:
        parts = []
        for path in self.paths:
            n = len(np.load(path, mmap_mode="r"))
            if n < 2:
                raise ValueError(f"{path}: a recording needs two frames")
            first = 0 if self.start is None else max(0, int(np.ceil(self.start * self.fps / 1000.0 - 1e-9)))
            end = n if self.end is None else min(n, int(np.floor(self.end * self.fps / 1000.0 + 1e-9)) + 1)
            parts += [_Part(path, at, min(end, at + self.chunk)) for at in range(first, end, self.chunk)]
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        images = np.load(partition.path, mmap_mode="r")
        raw = lambda i: np.ascontiguousarray(images[i], np.uint8).tobytes()
        first = 0 if self.start is None else max(0, int(np.ceil(self.start * self.fps / 1000.0 - 1e-9)))
        last = raw(partition.first - 1) if partition.first > first else None
        for i in range(partition.first, partition.end):
            now = raw(i)
            yield partition.path, i, i * 1000.0 / self.fps, images.shape[2], images.shape[1], now, last
            last = now


def read_raw(spark: SparkSession, paths: list[str], *, fps: float = DEFAULT_FPS, start_ms: float | None = None, end_ms: float | None = None, chunk_frames: int = 600) -> DataFrame:
    """Frames of long recordings, each with the one before it, through :class:`RawFrames`."""
    spark.dataSource.register(RawFrames)
    given = {"paths": ",".join(paths), "fps": fps, "chunk_frames": chunk_frames, "start_ms": start_ms, "end_ms": end_ms}
    return spark.read.format("raw_frames").options(**{k: str(v) for k, v in given.items() if v is not None}).load()


def flick_path(spark: SparkSession, n: int, fps: float, amplitude: float, duration: float, overshoot: float = 0.0) -> DataFrame:
    """i, t_s, yaw_deg: a minimum-jerk flick, with ``overshoot`` degrees too far and back."""
    t = F.col("i") / F.lit(float(fps))
    out = min_jerk(t, amplitude + overshoot, duration)
    if overshoot:
        out = out - min_jerk(t - duration, overshoot, 0.6 * duration)
    return spark.range(n).select(F.col("id").cast("int").alias("i")).select("i", t.alias("t_s"), out.alias("yaw_deg"))


def rendered_pan(n: int, width: int, height: int, yaw_deg: np.ndarray, fov_degrees: float, seed: int = 7, *, noise: float = 0.0, crosshair: bool = False, counter: list[int] | None = None, distractor: tuple[float, float] | None = None) -> np.ndarray:
    """Frames of a view that turns along ``yaw_deg`` before a seeded texture.

    ``noise``: deviation of grey levels. ``crosshair``: a cross in the middle.
    ``counter``: a number for each frame, drawn at the lower right on black.
    ``distractor``: a block of that share of the width that moves so many pixels a
    frame against the picture.
    """
    rng = np.random.default_rng(seed)
    focal = width / 2 / np.tan(np.radians(fov_degrees) / 2)
    offsets = np.rint(focal * np.tan(np.radians(yaw_deg))).astype(int)
    world = np.kron(rng.integers(30, 225, (height // 4 + 1, (width + int(np.ptp(offsets))) // 4 + 2)), np.ones((4, 4)))
    views = np.stack([world[:height, o : o + width] for o in offsets - offsets.min()])
    if noise:
        views = np.clip(views + rng.normal(0, noise, views.shape), 0, 255)
    if distractor:
        size = int(distractor[0] * width)
        block = np.kron(rng.integers(0, 255, (size // 4 + 1, size // 4 + 1)), np.ones((4, 4)))[: min(size, height), :size]
        for i, view in enumerate(views):
            x = int(np.clip(width // 8 + i * distractor[1], 0, width - size))
            view[: block.shape[0], x : x + size] = block
    for i, view in enumerate(views):
        if counter is not None:
            mark = written_text(str(counter[i]), max(2, height // 40))
            box = view[height - mark.shape[0] - 12 :, width - width // 4 :]
            box[:] = 0
            put(box, mark, 6, 6, 255)
        if crosshair:
            y, x = height // 2, width // 2
            view[y, x - 6 : x + 7] = view[y - 6 : y + 7, x] = 255
    return views.astype(np.uint8)
