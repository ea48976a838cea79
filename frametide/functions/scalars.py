"""Scalar functions as column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key prefixes of public services, as shapes and as a pattern to redact.
KEY_SHAPES = {
    "google": r"^AIza[0-9A-Za-z_\-]{30,}$",
    "openai": r"^sk-[0-9A-Za-z_\-]{20,}$",
    "anthropic": r"^sk-ant-[0-9A-Za-z_\-]{20,}$",
}
SECRET = r"\b(sk-ant-|sk-|AIza)[A-Za-z0-9_\-]{16,}"

OUTPUT_TOKENS = 400
RETRYABLE = (408, 409, 425, 429, 500, 502, 503, 504)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, as_col(low)), as_col(high))


def focal_length_px(width: Column | str, fov_degrees: Column | float) -> Column:
    """Pixels from eye to screen for a horizontal field of view; fails outside (1, 179) degrees."""
    fov = fov_degrees if isinstance(fov_degrees, Column) else F.lit(float(fov_degrees))
    checked = F.when((fov > 1) & (fov < 179), fov).otherwise(F.raise_error(F.lit("field of view must lie between 1 and 179 degrees")).cast("double"))
    return (col(width) / 2) / F.tan(F.radians(checked) / 2)


def px_to_deg(offset: Column | str, focal: Column) -> Column:
    """Angle of a cumulative pixel offset. Offsets are added up first: angles of single steps don't add."""
    return F.degrees(F.atan(col(offset) / focal))


def deg_to_px(angle: Column | str, focal: Column) -> Column:
    return focal * F.tan(F.radians(col(angle)))


def reaction_time(stimulus: Column | str, shot: Column | str, fps: Column | float) -> Column:
    """Struct of ms and error_ms, one whole frame interval; fails if the shot comes first."""
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    frames = col(shot) - col(stimulus)
    checked = F.when(frames < 0, F.raise_error(F.lit("shot before stimulus")).cast("double")).otherwise(frames * 1000.0 / rate)
    return F.struct(checked.alias("ms"), (F.lit(1000.0) / rate).alias("error_ms"))


def hann(i: Column | str, n: int, periodic: bool = True) -> Column:
    """A Hann window's i-th weight; a window of one sample is 1."""
    if n <= 1:
        return F.lit(1.0)
    return F.lit(0.5) - F.lit(0.5) * F.cos(2 * F.pi() * col(i) / F.lit(float(n if periodic else n - 1)))


def min_jerk(t: Column, amplitude: float | Column, duration: float | Column) -> Column:
    """Position on a minimum-jerk path that starts at 0."""
    amplitude = amplitude if isinstance(amplitude, Column) else F.lit(float(amplitude))
    duration = duration if isinstance(duration, Column) else F.lit(float(duration))
    tau = clip(t / duration, 0.0, 1.0)
    return amplitude * (10 * F.pow(tau, 3) - 15 * F.pow(tau, 4) + 6 * F.pow(tau, 5))


def image_tokens(width: Column | str, height: Column | str) -> Column:
    """Tokens of an image: patches of 28 pixels, and 15 % on top, rounded down."""
    return F.floor(F.ceil(col(width) / 28) * F.ceil(col(height) / 28) * F.lit(1.15)).cast("long")


def text_tokens(*texts: Column | str) -> Column:
    """A quarter of each text's characters, rounded down each, added up; null counts as empty."""
    return sum((F.floor(F.char_length(F.coalesce(col(t), F.lit(""))) / 4) for t in texts), F.lit(0)).cast("long")


def cost_usd(input_tokens: Column | str, rate_in: Column | str, rate_out: Column | str, output_tokens: int = OUTPUT_TOKENS) -> Column:
    return col(input_tokens) / 1e6 * col(rate_in) + F.lit(output_tokens / 1e6) * col(rate_out)


def cost_label(usd: Column | str, clips: Column | str, model: Column | str) -> Column:
    return F.format_string("~$%.3f · %d clips · %s", col(usd), col(clips), col(model))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def phash_bits(coefficients: Column | str) -> Column:
    """64 coefficients as bits of a long, the first as the highest: set if above the median of all but the first."""
    c = col(coefficients)
    ac = F.array_sort(F.slice(c, 2, 63))
    median = F.element_at(ac, 32)
    bits = F.transform(c, lambda x, i: F.when(x > median, F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(63) - i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def scrub(text: Column | str) -> Column:
    """The text with the secret part of keys replaced."""
    return F.regexp_replace(col(text), SECRET, "$1[REDACTED]")


def key_shape(provider: Column | str, key: Column | str) -> Column:
    """Whether a key has its provider's shape; null for an unknown provider."""
    out = F.lit(None).cast("boolean")
    for name, shape in KEY_SHAPES.items():
        out = F.when(col(provider) == name, col(key).rlike(shape)).otherwise(out)
    return out


def key_fingerprint(provider: Column | str, key: Column | str) -> Column:
    """Struct of last4, sha256_prefix and display: all that may be shown of a key."""
    k = col(key)
    last4 = F.right(k, F.lit(4))
    return F.struct(last4.alias("last4"), F.substring(F.sha2(k, 256), 1, 12).alias("sha256_prefix"), F.concat(col(provider), F.lit(": ••••"), last4).alias("display"))


def cache_key(clip_sha: Column | str, prompt_version: Column | str, model: Column | str, schema_version: Column | str) -> Column:
    """Hash that names a request's answer; a null part counts as empty."""
    parts = [F.coalesce(col(p), F.lit("")) for p in (clip_sha, prompt_version, model, schema_version)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def is_retryable(status: Column | str) -> Column:
    return col(status).isin(*RETRYABLE)


def finite(x: Column | str) -> Column:
    """The number, or null for NaN and infinities: numbers that JSON can't hold."""
    c = col(x)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def resolution(width: Column | str, height: Column | str) -> Column:
    return F.concat(col(width).cast("string"), F.lit("x"), col(height).cast("string"))


def crop_box(width: Column | str, height: Column | str, x: Column | str, y: Column | str, w: Column | str, h: Column | str) -> Column:
    """A normalised region in pixels, x0 y0 x1 y1; offsets and sizes are truncated each and cut at the frame; empty ones fail."""
    x0, y0 = F.floor(col(x) * col(width)), F.floor(col(y) * col(height))
    x1, y1 = F.least(col(width), x0 + F.floor(col(w) * col(width))), F.least(col(height), y0 + F.floor(col(h) * col(height)))
    box = F.struct(*[v.cast("int").alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])
    return F.when((x1 > x0) & (y1 > y0), box).otherwise(F.raise_error(F.lit("empty region")).cast("struct<x0:int,y0:int,x1:int,y1:int>"))
