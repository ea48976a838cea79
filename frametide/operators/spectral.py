"""Spectra of speed signals.

Signals have clip_id, i (dense from 0) and x. A clip's samples meet in one row as
an array, a few seconds long, and its transform is a fast Fourier transform in an
Arrow-fed function: time grows with n log n of a clip, and nothing but the clip
is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUT_HZ = 10.0
LEAST_MAGNITUDE = 0.05
PAD_LEVEL = 4
JITTER_BAND = (8.0, 30.0)
SEGMENT = 256


def finite_signal(signal: DataFrame) -> DataFrame:
    """Drops values that aren't finite and numbers the others anew."""
    kept = signal.filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
    return kept.withColumn("i", F.row_number().over(Window.partitionBy("clip_id").orderBy("i")) - 1)


def _finite(x: np.ndarray) -> np.ndarray:
    return x[np.isfinite(x)]


def _by_clip(signal: DataFrame, fields: list[T.StructField], rows_of: Callable[[np.ndarray], list[tuple]]) -> DataFrame:
    """``rows_of`` a clip's samples in order (null as NaN), each row led by clip_id."""
    whole = signal.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("i", F.col("x").cast("double").alias("x")))).alias("s"))
    whole = whole.select("clip_id", F.transform("s", lambda e: F.coalesce(e["x"], F.lit(float("nan")))).alias("s"))
    schema = T.StructType([whole.schema["clip_id"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            found = [rows_of(s.values.to_numpy(zero_copy_only=False)) for s in batch.column("s")]
            keys = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            columns = list(zip(*(r for f in found for r in f))) or [()] * len(fields)
            kinds = kinds or [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[f.dataType.simpleString().replace("bigint", "long")] for f in fields]
            yield pa.RecordBatch.from_arrays([batch.column("clip_id").take(pa.array(keys)), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    return whole.mapInArrow(run, schema)


def arc_length(x: np.ndarray, fs: float, cut: float, least: float, pad: int) -> float:
    n = len(x)
    if n < 4 or not np.abs(x).max() > 0:
        return 0.0
    size = 1 << (int(np.ceil(np.log2(n))) + pad)
    k = np.arange(min(size, int(np.floor(size * cut / fs)) + 1))
    half = np.abs(np.fft.rfft(x, size))
    m = half[np.minimum(k, size - k)] / half.max()  # beyond the middle the spectrum of a real signal mirrors itself
    strong = np.flatnonzero(m >= least)
    if not len(strong) or strong[0] == strong[-1]:
        return 0.0
    m = m[strong[0] : strong[-1] + 1]
    return float(-np.hypot(1 / (len(m) - 1), np.diff(m)).sum())


def sparc(signal: DataFrame, fs: float, cut: float = CUT_HZ, least: float = LEAST_MAGNITUDE, pad: int = PAD_LEVEL) -> DataFrame:
    """clip_id, sparc: minus the arc length of the normalised magnitude spectrum up to ``cut`` hertz.

    Values that aren't finite are left out. Bins are those of a transform padded
    to ``2 ** (ceil(log2 n) + pad)`` samples. Magnitudes are relative to the
    largest. The arc runs from the first to the last bin at or above ``least``. 0 for under four samples, a signal of zeros, or an
    arc without length.
    """
    return _by_clip(signal, [T.StructField("sparc", T.DoubleType())], lambda x: [(arc_length(_finite(x), fs, cut, least, pad),)])


def density(x: np.ndarray, fs: float, segment: int, overlap: int | None, detrend: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and mean one-sided density of a signal."""
    size = min(len(x), segment)
    shared = size // 2 if overlap is None else min(overlap, size - 1)
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[:: size - shared].astype(float)
    j = np.arange(size)
    if detrend == "constant":
        parts = parts - parts.mean(axis=1, keepdims=True)
    elif detrend == "linear":
        at = j - j.mean()
        slope = parts @ at / (at @ at) if size > 1 else np.zeros(len(parts))
        parts = parts - parts.mean(axis=1, keepdims=True) - slope[:, None] * at
    window = np.ones(1) if size == 1 else 0.5 - 0.5 * np.cos(2 * np.pi * j / size)
    k = np.arange(size // 2 + 1)
    power = (np.abs(np.fft.rfft(parts * window)) ** 2).mean(axis=0) / ((window**2).sum() * fs)
    return k * fs / size, power * np.where((k == 0) | (2 * k == size), 1.0, 2.0)


def welch(signal: DataFrame, fs: float, segment: int = SEGMENT, overlap: int | None = None, detrend: str | None = "constant") -> DataFrame:
    """clip_id, k, f, power: mean one-sided density over Hann-windowed segments.

    A segment has ``min(n, segment)`` samples, half of them shared with the next
    unless ``overlap`` says otherwise; samples that don't fill one are left out.
    ``detrend``: constant, linear or None.
    """
    if overlap is not None and not 0 <= overlap < segment:
        raise ValueError("overlap must be less than the segment")
    if detrend not in ("constant", "linear", None):
        raise ValueError(f"unknown detrend {detrend!r}")

    def rows_of(x: np.ndarray) -> list[tuple]:
        f, power = density(x, fs, segment, overlap, detrend)
        return list(zip(range(len(f)), f.tolist(), power.tolist()))

    return _by_clip(signal, [T.StructField("k", T.IntegerType()), T.StructField("f", T.DoubleType()), T.StructField("power", T.DoubleType())], rows_of)


def jitter_share(x: np.ndarray, fs: float, band: tuple[float, float]) -> float | None:
    if len(x) < 8:
        return 0.0
    if band[0] >= fs / 2:
        return None
    f, power = density(x - x.mean(), fs, SEGMENT, None, "constant")
    area = (power[1:] + power[:-1]) / 2 * np.diff(f)
    inside = (f[1:] <= min(band[1], fs / 2)) & (f[:-1] >= band[0])
    return float(np.clip(area[inside].sum() / area.sum(), 0.0, 1.0)) if area.sum() > 0 else 0.0


def jitter_ratio(signal: DataFrame, fs: float, band: tuple[float, float] = JITTER_BAND) -> DataFrame:
    """clip_id, jitter_ratio: the share of power within ``band``, by trapezoids, in [0, 1].

    Values that aren't finite are left out. 0 for under eight samples, without
    power, or without bins in the band; null if the band lies beyond what ``fs``
    resolves.
    """
    return _by_clip(signal, [T.StructField("jitter_ratio", T.DoubleType())], lambda x: [(jitter_share(_finite(x), fs, band),)])
