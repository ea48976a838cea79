"""Operators on raw frames, as Arrow-fed functions of NumPy arrays.

Frames have session_id, frame, w, h and pixels (w * h bytes of grey, or three
times that of colour). Only what needs the pixels is done here; the rest of the
engine works on the rows that come out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frametide.operators.geometry import fill_forward
from frametide.operators.traces import motion_ok


def grey(pixels: bytes, w: int, h: int) -> np.ndarray:
    a = np.frombuffer(pixels, np.uint8)
    if len(a) == w * h:
        return a.reshape(h, w)
    return np.rint(a.reshape(h, w, 3) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def resize(image: np.ndarray, size: int) -> np.ndarray:
    """Area means over ``size`` by ``size`` cells; small images repeat their pixels."""
    cells = lambda n: [(i * n // size, max(i * n // size + 1, (i + 1) * n // size)) for i in range(size)]
    return np.array([[image[a:b, c:d].mean() for c, d in cells(image.shape[1])] for a, b in cells(image.shape[0])])


def dct_coefficients(image: np.ndarray, size: int = 32, keep: int = 8) -> np.ndarray:
    """The ``keep * keep`` lowest cosine coefficients of the image resized to ``size``."""
    k, x = np.arange(keep)[:, None], np.arange(size)[None, :]
    basis = np.cos(np.pi * (2 * x + 1) * k / (2 * size)) * np.where(k == 0, np.sqrt(1 / size), np.sqrt(2 / size))
    return (basis @ resize(image, size) @ basis.T).ravel()


def phash(image: np.ndarray) -> int:
    """A perceptual hash as an unsigned 64-bit number."""
    c = dct_coefficients(image)
    return int("".join("1" if x > np.median(c[1:]) else "0" for x in c), 2)


def match_template(image: np.ndarray, template: np.ndarray) -> float | None:
    """The highest normalised correlation of the template at any place; None if it doesn't fit."""
    th, tw = template.shape
    if image.shape[0] < th or image.shape[1] < tw:
        return None
    windows = np.lib.stride_tricks.sliding_window_view(image.astype(float), (th, tw))
    centred = windows - windows.mean(axis=(2, 3), keepdims=True)
    t = template - template.mean()
    scale = np.sqrt((centred**2).sum(axis=(2, 3)) * (t**2).sum())
    score = np.divide((centred * t).sum(axis=(2, 3)), scale, out=np.zeros_like(scale), where=scale > 0)
    return float(score.max())


def region(h: int, w: int, roi: tuple[float, float, float, float]) -> tuple[slice, slice]:
    """Rows and columns of a region given in shares of the picture, cut at its far edges."""
    x, y, dx, dy = (int(share * size) for share, size in zip(roi, (w, h, w, h)))
    return slice(y, min(h, y + dy)), slice(x, min(w, x + dx))


def crop(image: np.ndarray, roi: tuple[float, float, float, float]) -> np.ndarray:
    out = image[region(*image.shape[:2], roi)]
    if out.size == 0:
        raise ValueError("empty region")
    return out


def feed_rows(frames: DataFrame, roi: tuple[float, float, float, float], rows: int = 5, reach: int = 12) -> DataFrame:
    """session_id, frame, row, std, uniformity, hash: each of the region's equal rows, measured."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, f, w, h, px in zip(pdf["session_id"], pdf["frame"], pdf["w"], pdf["h"], pdf["pixels"]):
                area = crop(grey(px, w, h), roi)
                step = area.shape[0] // rows
                for r in range(rows if step else 0):
                    row = area[r * step : (r + 1) * step]
                    counts = np.bincount(row.ravel(), minlength=256)
                    mode = int(counts.argmax())
                    near = counts[max(0, mode - reach) : mode + reach + 1].sum() / row.size
                    value = phash(row)
                    out.append((s, f, r, float(row.std()), float(near), value - (1 << 64) if value >> 63 else value))
            yield pd.DataFrame(out, columns=["session_id", "frame", "row", "std", "uniformity", "hash"])

    return frames.select("session_id", "frame", "w", "h", "pixels").mapInPandas(run, "session_id string, frame int, row int, std double, uniformity double, hash long")


def hit_scores(frames: DataFrame, template: np.ndarray, roi: tuple[float, float, float, float]) -> DataFrame:
    """session_id, frame, score: the template's best match in the region, null where it doesn't fit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = [match_template(crop(grey(px, w, h), roi), template) for w, h, px in zip(pdf["w"], pdf["h"], pdf["pixels"])]
            yield pd.DataFrame({"session_id": pdf["session_id"], "frame": pdf["frame"], "score": scores})

    return frames.select("session_id", "frame", "w", "h", "pixels").mapInPandas(run, "session_id string, frame int, score double")


def shift_between(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> tuple[float, float, float]:
    """Whole-frame shift from ``a`` to ``b`` by phase correlation with a parabolic peak: dx, dy, share of the peak."""
    a, b = a.astype(float) - a.mean(), b.astype(float) - b.mean()
    if mask is not None:
        a, b = a * mask, b * mask
    window = np.outer(np.hanning(a.shape[0]), np.hanning(a.shape[1]))
    cross = np.fft.fft2(b * window) * np.conj(np.fft.fft2(a * window))
    size = np.abs(cross)
    if size.max() < 1e-9:
        return 0.0, 0.0, 0.0
    peak = np.fft.ifft2(cross / np.maximum(size, 1e-9 * size.max())).real
    y, x = np.unravel_index(peak.argmax(), peak.shape)

    def fine(lo: float, mid: float, hi: float) -> float:
        bend = lo - 2 * mid + hi
        return 0.5 * (lo - hi) / bend if bend else 0.0

    h, w = peak.shape
    dy = y + fine(peak[(y - 1) % h, x], peak[y, x], peak[(y + 1) % h, x])
    dx = x + fine(peak[y, (x - 1) % w], peak[y, x], peak[y, (x + 1) % w])
    return float(dx - w if dx > w / 2 else dx), float(dy - h if dy > h / 2 else dy), float(peak.max())


def world_mask(h: int, w: int, excluded: list[tuple[float, float, float, float]], centre: float = 0.15) -> np.ndarray:
    """Where motion may be measured: outside the screen furniture and the middle, where the crosshair is."""
    mask = np.ones((h, w))
    for x, y, dx, dy in [*excluded, (0.5 - centre / 2, 0.5 - centre / 2, centre, centre)]:
        mask[int(y * h) : int((y + dy) * h) + 1, int(x * w) : int((x + dx) * w) + 1] = 0
    return mask


def patch_corners(image: np.ndarray, size: int, most: int, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Top rows and left columns of the patches on a grid of at most about ``most`` that have texture in both directions and lie wholly inside the mask."""
    h, w = image.shape
    step = max(size // 2, int(np.sqrt(h * w / most)))
    ys, xs = (g.ravel() for g in np.meshgrid(np.arange(0, h - size + 1, step), np.arange(0, w - size + 1, step), indexing="ij"))
    gy, gx = np.gradient(image.astype(float))

    def sums(values: np.ndarray) -> np.ndarray:
        total = np.pad(values.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
        return total[ys + size, xs + size] - total[ys, xs + size] - total[ys + size, xs] + total[ys, xs]

    xx, yy, xy = sums(gx * gx), sums(gy * gy), sums(gx * gy)
    least = (xx + yy - np.hypot(xx - yy, 2 * xy)) / 2  # the weaker direction's strength
    good = least > max(0.01 * least.max(initial=0.0), float(size * size))
    if mask is not None:
        good &= sums(mask) > size * size - 0.5
    return ys[good], xs[good]


def track(a: np.ndarray, b: np.ndarray, ys: np.ndarray, xs: np.ndarray, size: int, guess: tuple[int, int], reach: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where patches of ``a`` went in ``b``, around a guessed shift (rows, columns): which were looked for, dy, dx and their correlation."""
    h, w = a.shape
    top, left = ys + guess[0], xs + guess[1]
    inside = (top >= reach + 1) & (left >= reach + 1) & (top + size + reach + 1 <= h) & (left + size + reach + 1 <= w)
    ys, xs, top, left = ys[inside], xs[inside], top[inside], left[inside]
    of_a, of_b = (np.lib.stride_tricks.sliding_window_view(x.astype(float), (size, size)) for x in (a, b))
    t = of_a[ys, xs]
    t = t - t.mean(axis=(1, 2), keepdims=True)
    t_size = np.sqrt((t**2).sum(axis=(1, 2)))
    wide = 2 * reach + 1
    score = np.zeros((len(ys), wide, wide))
    for i in range(wide):
        for j in range(wide):
            p = of_b[top + i - reach, left + j - reach]
            p = p - p.mean(axis=(1, 2), keepdims=True)
            scale = t_size * np.sqrt((p**2).sum(axis=(1, 2)))
            score[:, i, j] = np.divide((t * p).sum(axis=(1, 2)), scale, out=np.zeros(len(ys)), where=scale > 0)
    n = np.arange(len(ys))
    best = score.reshape(len(ys), -1).argmax(axis=1) if len(ys) else np.zeros(0, int)
    i, j = best // wide, best % wide

    def fine(lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> np.ndarray:
        bend = lo - 2 * mid + hi
        return np.clip(np.divide(0.5 * (lo - hi), bend, out=np.zeros(len(bend)), where=bend != 0), -0.5, 0.5)

    up, down, before, after = (np.clip(x, 0, wide - 1) for x in (i - 1, i + 1, j - 1, j + 1))
    top_score = score[n, i, j]
    dy = guess[0] + i - reach + fine(score[n, up, j], top_score, score[n, down, j])
    dx = guess[1] + j - reach + fine(score[n, i, before], top_score, score[n, i, after])
    return inside, dy, dx, top_score


def estimate_motion(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None, *, size: int = 16, most: int = 400, alike: float = 0.8, agree_px: float = 2.0) -> tuple[float, float, int, int, float]:
    """The camera's shift from one grey frame to the next, opposite to the picture's: dx, dy, inliers, tracked, spread.

    The picture's shift as a whole says where to look; textured patches are then
    tracked one by one. Those found again are ``tracked``, those within
    ``agree_px`` of the middle one are ``inliers`` and give the shift. ``spread``:
    the lesser deviation of the inliers' places, relative to the picture. Zeros
    where there is nothing to track.
    """
    h, w = a.shape
    if min(h, w) < 2 * size:
        return 0.0, 0.0, 0, 0, 0.0
    ys, xs = patch_corners(a, size, most, mask)
    if not len(ys):
        return 0.0, 0.0, 0, 0, 0.0
    gx, gy, _ = shift_between(a, b, mask)
    inside, dy, dx, score = track(a, b, ys, xs, size, (round(gy), round(gx)))
    found = score >= alike
    if not found.any():
        return 0.0, 0.0, 0, 0, 0.0
    dy, dx, at = dy[found], dx[found], np.stack([ys[inside][found] / h, xs[inside][found] / w])
    near = np.hypot(dy - np.median(dy), dx - np.median(dx)) <= agree_px
    spread = float(at[:, near].std(axis=1).min()) if near.sum() > 1 else 0.0
    return -float(dx[near].mean()) if near.any() else 0.0, -float(dy[near].mean()) if near.any() else 0.0, int(near.sum()), int(found.sum()), spread


def motion_estimates(frames: DataFrame, excluded: list[tuple[float, float, float, float]] | None = None) -> DataFrame:
    """clip_id, i, dx, dy, inliers, tracked, spread, ok: the camera's shift since the frame before; a recording's first frame has none and is ok.

    ``excluded``: regions that don't move with the world; None measures
    everywhere. Frames that carry the one before (column ``before``, as
    ``read_frames(pairs=True)`` gives them) are measured where they are; others
    are sorted by session first, which moves every picture.
    """
    if "before" in frames.columns:
        pairs = frames.select("session_id", "frame", "w", "h", "pixels", "before")
    else:
        w_ = Window.partitionBy("session_id").orderBy("frame")
        pairs = frames.select("session_id", "frame", "w", "h", "pixels", F.lag("pixels").over(w_).alias("before"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, f, w, h, px, last in zip(pdf["session_id"], pdf["frame"], pdf["w"], pdf["h"], pdf["pixels"], pdf["before"]):
                if last is None:
                    out.append((str(s), f, 0.0, 0.0, 0, 0, 0.0, True))
                    continue
                mask = world_mask(h, w, excluded) if excluded is not None else None
                out.append((str(s), f, *estimate_motion(grey(last, w, h), grey(px, w, h), mask), False))
            yield pd.DataFrame(out, columns=["clip_id", "i", "dx", "dy", "inliers", "tracked", "spread", "first"])

    found = pairs.mapInPandas(run, "clip_id string, i int, dx double, dy double, inliers int, tracked int, spread double, first boolean")
    return found.withColumn("ok", F.col("first") | motion_ok()).drop("first")


def otsu(image: np.ndarray) -> int:
    """The grey level that parts an image best in two."""
    counts = np.bincount(image.ravel(), minlength=256).astype(float)
    below, levels = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = levels / below - (levels[-1] - levels) / above
        return int(np.nan_to_num(below * above * gap**2).argmax())


def components(binary: np.ndarray) -> list[np.ndarray]:
    """The coordinates (rows of y, x) of each group of set pixels that touch, diagonals included."""
    label = np.where(binary, np.arange(1, binary.size + 1).reshape(binary.shape), 0)
    while True:
        wide = np.pad(label, 1)
        best = np.max([wide[dy : dy + label.shape[0], dx : dx + label.shape[1]] for dy in range(3) for dx in range(3)], axis=0)
        best = np.where(binary, best, 0)
        if np.array_equal(best, label):
            break
        label = best
    ys, xs = np.nonzero(binary)
    by = label[ys, xs]
    order = np.argsort(by, kind="stable")
    cuts = np.flatnonzero(np.diff(by[order])) + 1
    return [np.column_stack([ys[g], xs[g]]) for g in np.split(order, cuts)] if len(order) else []


def stretch(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Nearest-pixel resize."""
    ys, xs = (np.arange(h) * image.shape[0] // h), (np.arange(w) * image.shape[1] // w)
    return image[np.ix_(ys, xs)].astype(float)


def glyph(image: np.ndarray) -> np.ndarray:
    """A glyph cut to its set pixels and made 24 by 16."""
    ys, xs = np.nonzero(image)
    return stretch(image[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] if len(ys) else image, 24, 16)


def classify(image: np.ndarray, templates: dict[int, np.ndarray]) -> tuple[int, float]:
    """The digit whose template correlates best with a glyph, the lowest of ties, and how well."""
    a = glyph(image)
    a = a - a.mean()
    best = (-1, -1.0)
    for digit in sorted(templates):
        b = templates[digit] - templates[digit].mean()
        scale = np.sqrt((a**2).sum() * (b**2).sum())
        score = float((a * b).sum() / scale) if scale else 0.0
        if score > best[1]:
            best = (digit, score)
    return best


#: What counts as a glyph (set pixels, shares of the picture's height and of the tallest one).
GLYPH_PIXELS, GLYPH_WIDEST, GLYPH_TALLEST, LINE_HEIGHT, DIGIT_HEIGHT, LEAST_SCORE = 12, 0.9, 0.9, 0.12, 0.55, 0.45


def read_number(image: np.ndarray, templates: dict[int, np.ndarray], least: float = LEAST_SCORE) -> tuple[int | None, float]:
    """The number in a grey image, all digits or none."""
    bad = set(templates) - set(range(10))
    if bad:
        raise ValueError(f"templates for {sorted(bad)}: only digits 0 to 9 have one")
    binary = image > otsu(image)
    if binary.mean() > 0.5:
        binary = ~binary
    h, w = binary.shape
    boxes = []
    for points in components(binary):
        (y0, x0), (y1, x1) = points.min(axis=0), points.max(axis=0) + 1
        if len(points) > GLYPH_PIXELS and x1 - x0 < GLYPH_WIDEST * w and y1 - y0 < GLYPH_TALLEST * h:
            boxes.append((x0, y0, x1, y1))
    tallest = max((b[3] - b[1] for b in boxes), default=0)
    if not boxes or tallest < LINE_HEIGHT * h:
        return None, 0.0
    found = [classify(binary[b[1] : b[3], b[0] : b[2]], templates) for b in sorted(boxes) if b[3] - b[1] >= DIGIT_HEIGHT * tallest]
    if min(score for _, score in found) < least:
        return None, 0.0
    return int("".join(str(d) for d, _ in found)), float(np.mean([score for _, score in found]))


def counter_readings(frames: DataFrame, roi: tuple[float, float, float, float], templates: dict[int, np.ndarray]) -> DataFrame:
    """session_id, frame, value, confidence: the counter in the region, null where it can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [read_number(crop(grey(px, w, h), roi), templates) for w, h, px in zip(pdf["w"], pdf["h"], pdf["pixels"])]
            yield pd.DataFrame({"session_id": pdf["session_id"], "frame": pdf["frame"], "value": pd.array([v for v, _ in got], "Int32"), "confidence": [c for _, c in got]})

    return frames.select("session_id", "frame", "w", "h", "pixels").mapInPandas(run, "session_id string, frame int, value int, confidence double")


def hsv(image: np.ndarray) -> np.ndarray:
    """Blue, green, red bytes as hue (0 to 179), saturation and value (0 to 255)."""
    b, g, r = (image[..., i].astype(float) for i in range(3))
    top, low = image.max(axis=-1).astype(float), image.min(axis=-1).astype(float)
    span = np.where(top > low, top - low, 1)
    hue = np.select([top == r, top == g], [60 * (g - b) / span, 120 + 60 * (b - r) / span], 240 + 60 * (r - g) / span)
    hue = np.where(top > low, hue % 360, 0) / 2
    return np.stack([np.rint(hue) % 180, np.rint(np.where(top > 0, 255 * (top - low) / np.maximum(top, 1), 0)), top], axis=-1)


def targets(image: np.ndarray, lower: list[int], upper: list[int], min_area: int = 60) -> list[tuple[float, float, float]]:
    """Coloured targets as (x, y, area in pixels), the largest first; specks under three pixels wide are opened away."""
    colours = hsv(image)
    mask = ((colours >= lower) & (colours <= upper)).all(axis=-1)
    around = lambda m, edge: np.lib.stride_tricks.sliding_window_view(np.pad(m, 1, constant_values=edge), (3, 3))
    mask = around(around(mask, True).all(axis=(2, 3)), False).any(axis=(2, 3))
    found = [(float(p[:, 1].mean()), float(p[:, 0].mean()), float(len(p))) for p in components(mask) if len(p) >= min_area]
    return sorted(found, key=lambda t: -t[2])


def target_points(frames: DataFrame, lower: list[int], upper: list[int], min_area: int = 60) -> DataFrame:
    """session_id, frame, cx, cy, area: a row a target."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, f, w, h, px in zip(pdf["session_id"], pdf["frame"], pdf["w"], pdf["h"], pdf["pixels"]):
                out += [(s, f, *t) for t in targets(np.frombuffer(px, np.uint8).reshape(h, w, 3), lower, upper, min_area)]
            yield pd.DataFrame(out, columns=["session_id", "frame", "cx", "cy", "area"])

    return frames.select("session_id", "frame", "w", "h", "pixels").mapInPandas(run, "session_id string, frame int, cx double, cy double, area double")


def target_counts(frames: DataFrame, lower: list[int], upper: list[int], min_area: int = 60) -> DataFrame:
    """session_id, frame, n_targets for every frame, 0 included."""
    found = target_points(frames, lower, upper, min_area).groupBy("session_id", "frame").agg(F.count("*").cast("int").alias("n"))
    return frames.select("session_id", "frame").join(found, ["session_id", "frame"], "left").select("session_id", "frame", F.coalesce("n", F.lit(0)).alias("n_targets"))


def png(image: np.ndarray) -> bytes:
    """A grey or colour (red, green, blue) image as PNG."""
    h, w = image.shape[:2]
    colour = 2 if image.ndim == 3 else 0
    raw = b"".join(b"\0" + image[y].astype(np.uint8).tobytes() for y in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def draw_path(image: np.ndarray, xs: np.ndarray, ys: np.ndarray, turns: set[int]) -> np.ndarray:
    """The picture with a path drawn over it, its turning points as small squares."""
    out = np.stack([image] * 3, axis=-1) if image.ndim == 2 else image.copy()
    h, w = out.shape[:2]
    for k in range(1, len(xs)):
        n = int(max(abs(xs[k] - xs[k - 1]), abs(ys[k] - ys[k - 1]))) + 1
        for x, y in zip(np.linspace(xs[k - 1], xs[k], n + 1), np.linspace(ys[k - 1], ys[k], n + 1)):
            if 0 <= int(y) < h and 0 <= int(x) < w:
                out[int(y), int(x)] = (255, 210, 0)
        if k in turns:
            y, x = int(ys[k]), int(xs[k])
            out[max(0, y - 2) : max(0, y + 3), max(0, x - 2) : max(0, x + 3)] = (255, 40, 40)
    return out


#: Digits, point, minus and s, five rows of three.
FONT = {
    "0": "111101101101111", "1": "010110010010111", "2": "111001111100111", "3": "111001111001111", "4": "101101111001001",
    "5": "111100111001111", "6": "111100111101111", "7": "111001001001001", "8": "111101111101111", "9": "111101111001111",
    ".": "000000000000010", "-": "000000111000000", "s": "011100010001110",
}


def written_text(text: str, scale: int = 2) -> np.ndarray:
    """Text of the font's characters as a picture of ones and zeros; others are blanks."""
    marks = [np.array([int(c) for c in FONT.get(ch, "0" * 15)]).reshape(5, 3) for ch in text]
    line = np.hstack([np.pad(m, ((0, 0), (0, 1))) for m in marks]) if marks else np.zeros((5, 0), int)
    return np.kron(line, np.ones((scale, scale), int))


def font_templates(scale: int = 8) -> dict[int, np.ndarray]:
    """Digit templates drawn from the font."""
    return {d: glyph(written_text(str(d), scale)) for d in range(10)}


def put(image: np.ndarray, mark: np.ndarray, y: int, x: int, value: object) -> None:
    """Draws a mark's set pixels into an image, cut at its edges."""
    part = image[y : y + mark.shape[0], x : x + mark.shape[1]]
    part[mark[: part.shape[0], : part.shape[1]] > 0] = value


def draw_sparkline(image: np.ndarray, values: np.ndarray, height: int) -> np.ndarray:
    """The picture with a curve of values along its lower edge, the greatest on top."""
    h, w = image.shape[:2]
    low, high = float(np.min(values)), float(np.max(values))
    share = (np.asarray(values, float) - low) / (high - low) if high > low else np.zeros(len(values))
    xs = np.linspace(0, w - 1, len(values)) if len(values) > 1 else np.zeros(len(values))
    return draw_path(image, xs, h - 1 - share * (height - 1), set())


def frame_grids(tiles: DataFrame, columns: int = 3, size: int = 384) -> DataFrame:
    """clip_id, image (PNG): a clip's tiles, each fitted into a square of ``size`` with its seconds in the corner, in rows of ``columns``.

    ``tiles``: clip_id, tile, label_s, w, h, pixels; a tile without pixels
    repeats the last that has them. A clip's tiles, a handful, meet in one row.
    """
    filled = fill_forward(tiles, ["clip_id"], "tile", "pixels")
    whole = filled.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("tile", "label_s", "w", "h", "pixels"))).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for clip, parts in zip(pdf["clip_id"], pdf["t"]):
                cells = []
                for t in parts:
                    cell = np.zeros((size, size), np.uint8)
                    if t["pixels"] is not None:
                        image = grey(t["pixels"], t["w"], t["h"])
                        scale = size / max(image.shape)
                        h, w = (max(1, int(n * scale)) for n in image.shape)
                        top, left = (size - h) // 2, (size - w) // 2
                        cell[top : top + h, left : left + w] = stretch(image, h, w)
                    put(cell, written_text(f"{t['label_s']:.2f}s"), 4, 4, 255)
                    cells.append(cell)
                cells += [np.zeros((size, size), np.uint8)] * (-len(cells) % columns)
                out.append((clip, png(np.vstack([np.hstack(cells[i : i + columns]) for i in range(0, len(cells), columns)]))))
            yield pd.DataFrame(out, columns=["clip_id", "image"])

    return whole.mapInPandas(run, T.StructType([whole.schema["clip_id"], T.StructField("image", T.BinaryType())]))


def growing_overlays(frames: DataFrame, clips: DataFrame, fov_degrees: float) -> DataFrame:
    """clip_id, i, image (PNG): each frame of a clip with the path up to it, its sparkline and what the speed reads.

    ``frames``: clip_id, i, w, h, pixels; ``clips``: clip_id, yaw_deg, pitch_deg,
    speed_dps (arrays) and turns, one row a clip. A clip's arrays travel with each
    of its frames, so no path is stored once for every prefix.
    """
    names = ["clip_id", "i", "w", "h", "pixels", "yaw_deg", "pitch_deg", "speed_dps", "turns"]
    drawn = frames.select("clip_id", "i", "w", "h", "pixels").join(clips.select("clip_id", "yaw_deg", "pitch_deg", "speed_dps", "turns"), "clip_id").filter("i >= 1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for clip, i, w, h, px, yaw, pitch, speed, turns in zip(*(pdf[n] for n in names)):
                focal, upto = w / 2 / np.tan(np.radians(fov_degrees) / 2), slice(0, i + 1)
                at = lambda deg, middle, focal=focal, upto=upto: middle + focal * np.tan(np.radians(np.asarray(deg, float)[upto]))
                image = draw_path(grey(px, w, h), at(yaw, w / 2), at(pitch, h / 2), {int(t) for t in turns if t <= i})
                image = draw_sparkline(image, np.asarray(speed, float)[upto], max(2, h // 6))
                put(image, written_text(f"{float(speed[min(i, len(speed) - 1)]):.0f}"), 4, 4, (255, 255, 255))
                out.append((clip, i, png(image)))
            yield pd.DataFrame(out, columns=["clip_id", "i", "image"])

    return drawn.mapInPandas(run, T.StructType([drawn.schema["clip_id"], T.StructField("i", T.IntegerType()), T.StructField("image", T.BinaryType())]))


def overlays(clips: DataFrame, fov_degrees: float) -> DataFrame:
    """clip_id, image (PNG): a clip's path over one of its frames. ``clips``: clip_id, w, h, pixels, yaw_deg and pitch_deg (arrays), turns (array of samples)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for c, w, h, px, yaw, pitch, turns in zip(*(pdf[n] for n in ("clip_id", "w", "h", "pixels", "yaw_deg", "pitch_deg", "turns"))):
                focal = w / 2 / np.tan(np.radians(fov_degrees) / 2)
                at = lambda deg, middle, focal=focal: middle + focal * np.tan(np.radians(np.asarray(deg, float)))
                out.append((c, png(draw_path(grey(px, w, h), at(yaw, w / 2), at(pitch, h / 2), set(map(int, turns))))))
            yield pd.DataFrame(out, columns=["clip_id", "image"])

    return clips.mapInPandas(run, "clip_id string, image binary")
