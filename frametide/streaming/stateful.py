"""Structured Streaming forms: engagements by session windows, and detectors with state.

Lateness: rows later than the watermark are dropped by sessions and by
deduplication; detectors take each micro-batch's rows of a session in frame order
and skip frames at or before the last one seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frametide.operators.detect import HISTORY, HIT_SCORE, MATCH_BITS, MAX_STEP, PERSISTENCE, SPAWN_FRAMES
from frametide.sources.scratch import remove, scratch_path


def session_engagements(events: DataFrame, at: str, gap: str, *, delay: str = "0 seconds") -> DataFrame:
    """session_id, start, end, n: bursts of events, closed ``gap`` after their last; batch or stream."""
    if events.isStreaming:
        events = events.withWatermark(at, delay)
    w = F.session_window(at, gap)
    return events.groupBy("session_id", w).agg(F.count("*").alias("n")).select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _fold(schema: str, state: str, start: tuple, step):
    """A session's rows in order through ``step(state, row) -> (state, rows out)``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        now = group.get if group.exists else start
        out: list[tuple] = []
        rows = pd.concat(list(batches)).sort_values("frame", kind="stable")
        for row in rows.itertuples(index=False):
            if row.frame <= now[0]:
                continue
            now, found = step(now, row)
            now = (int(row.frame), *now[1:])
            out.extend((key[0], *f) for f in found)
        group.update(now)
        yield pd.DataFrame(out, columns=names)

    return lambda df: df.groupBy("session_id").applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def stream_counter_decrements(readings: DataFrame, max_step: int = MAX_STEP) -> DataFrame:
    """Shots from a stream of session_id, frame, value: session_id, frame, nth."""

    def step(now: tuple, row) -> tuple[tuple, list]:
        if row.value is None or row.value != row.value:
            return now, []
        fell = now[1] - int(row.value) if now[1] is not None else 0
        found = [(int(row.frame), n + 1) for n in range(fell)] if 1 <= fell <= max_step else []
        return (now[0], int(row.value)), found

    return _fold("session_id long, frame int, nth int", "frame long, previous int", (-1, None), step)(readings)


def stream_rising_edges(scores: DataFrame, threshold: float = HIT_SCORE) -> DataFrame:
    """Hits from a stream of session_id, frame, score: session_id, frame, score."""

    def step(now: tuple, row) -> tuple[tuple, list]:
        if row.score is None or row.score != row.score:
            return now, []
        on = row.score >= threshold
        return (now[0], on), [(int(row.frame), float(row.score))] if on and not now[1] else []

    return _fold("session_id long, frame int, score double", "frame long, on boolean", (-1, False), step)(scores)


def stream_feed_kills(frames: DataFrame, bits: int = MATCH_BITS, persistence: int = PERSISTENCE, history: int = HISTORY) -> DataFrame:
    """Kills from a stream of session_id, frame, hashes (array, by slot): session_id, frame, slot, hash.

    State is what the next frame needs: each slot's last hash, where its run began
    and its length, and the last ``history`` hashes emitted.
    """
    unsigned = lambda h: int(h) & ((1 << 64) - 1)
    differ = lambda a, b: (unsigned(a) ^ unsigned(b)).bit_count()

    def step(now: tuple, row) -> tuple[tuple, list]:
        _, last, began, length, seen = now
        last, began, length, seen = list(last), list(began), list(length), list(seen)
        hashes, found = [int(h) for h in (row.hashes if row.hashes is not None else [])], []
        chained = row.frame == now[0] + 1
        for slot, h in enumerate(hashes):
            goes_on = chained and slot < len(last) and differ(h, last[slot]) <= bits
            if slot >= len(began):
                began.append(0)
                length.append(0)
            began[slot], length[slot] = (began[slot], length[slot] + 1) if goes_on else (int(row.frame), 1)
            if length[slot] == persistence and all(differ(h, s) > bits for s in seen):
                found.append((began[slot], slot, h))
                seen = [*seen, h][-history:]
        n = len(hashes)
        return (now[0], hashes, began[:n], length[:n], seen), found

    state = "frame long, last array<long>, began array<long>, length array<long>, seen array<long>"
    return _fold("session_id long, frame int, slot int, hash long", state, (-1, [], [], [], []), step)(frames)


def stream_budget(requests: DataFrame, limit_usd: float) -> DataFrame:
    """Admission in a stream of session_id, frame (order), usd: session_id, frame, usd, admitted."""

    def step(now: tuple, row) -> tuple[tuple, list]:
        ok = now[1] + row.usd <= limit_usd
        return (now[0], now[1] + row.usd if ok else now[1]), [(int(row.frame), float(row.usd), bool(ok))]

    return _fold("session_id long, frame int, usd double, admitted boolean", "frame long, spent double", (-1, 0.0), step)(requests)


def stream_target_spawns(counts: DataFrame, hold: int = SPAWN_FRAMES) -> DataFrame:
    """Spawns from a stream of session_id, frame, n_targets: session_id, frame, n_targets.

    A frame is decided once ``hold`` more have come, so output lags by that much.
    A session's plausibility gate needs all of it: apply it to the result.
    """

    def step(now: tuple, row) -> tuple[tuple, list]:
        _, confirmed, frames, counts_ = now
        frames, counts_ = [*frames, int(row.frame)], [*counts_, int(row.n_targets)]
        found = []
        if len(counts_) > hold:
            count, rises = counts_[0], counts_[0] > confirmed and min(counts_[:hold]) >= counts_[0]
            if rises:
                found.append((frames[0], count))
            if rises or count < confirmed:
                confirmed = count
            frames, counts_ = frames[1:], counts_[1:]
        return (now[0], confirmed, frames, counts_), found

    return _fold("session_id long, frame int, n_targets int", "frame long, confirmed int, frames array<int>, counts array<int>", (-1, 0, [], []), step)(counts)


def stream_token_bucket(arrivals: DataFrame, rate: float, burst: float) -> DataFrame:
    """Waits in a stream of session_id, frame (order), at (seconds): session_id, frame, wait_s."""

    def step(now: tuple, row) -> tuple[tuple, list]:
        start = row.at if now[1] is None else max(row.at, now[1])
        have = burst if now[1] is None else min(burst, now[2] + (start - now[1]) * rate)
        wait = 0.0 if have >= 1 else (1 - have) / rate
        return (now[0], float(start + wait), float(have + wait * rate - 1)), [(int(row.frame), float(start + wait - row.at))]

    return _fold("session_id long, frame int, wait_s double", "frame long, now double, tokens double", (-1, None, burst), step)(arrivals)


def through_stream(batch: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a streaming transformation over a table's rows and returns what it appended.

    The rows are written to the folder that all executors share, read back as a
    stream until all are consumed, and the sink's files are read. Input and state
    go at once, what was appended when the driver's JVM ends.
    """
    spark = batch.sparkSession
    at = scratch_path(spark, "stream")
    batch.write.parquet(f"{at}/in")
    out = transform(spark.readStream.schema(batch.schema).parquet(f"{at}/in"))
    out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    for part in ("in", "state"):
        remove(spark, f"{at}/{part}")
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def once_by_key(requests: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Each key's first request within the watermark."""
    return requests.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
