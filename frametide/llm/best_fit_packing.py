"""Best-fit packing planned on the histogram of lengths.

Only a piece's length matters to a packer, so the plan is made for counts: at
most ``width`` lengths with a number each, whatever the corpus' size. Best-fit
decreasing runs over those counts, moving whole runs of equal sequences at once,
and yields a list of *slots*: "the pieces of length L and ranks r to r + n take
place at offset o of sequences s to s + n". Every piece then finds its slot by
its rank within its length. Ranks need no sort: each task numbers the pieces of
a length as it writes them, and a task's start is the sum of the counts of those
before it. These starts, a row for each length in each task, are broadcast while
they are few, so that ids stay where they are; beyond that both sides are
shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frametide.llm._common import broadcast_if_small, discard, materialise, pick, table
from frametide.llm._words import chunks, id_cache, tokenizer_path

WIDTH = 4096
END_ID = 1
#: Bytes of ids after which a task hands pieces on.
BATCH_BYTES = 8 << 20
#: Most starts that are broadcast.
MOST_STARTS = 1 << 18


def pieces(docs: DataFrame, *, width: int = WIDTH, end_id: int = END_ID, tokenizer: str | None = None, keep_ids: bool = False, cache_chunks: int | None = None) -> DataFrame:
    """Tokenises every whole text and cuts what is longer than ``width``.

    Columns: doc_id, piece, start, length, task and local_rank (the piece's
    number among those of its length in its task), and ids (binary) if
    ``keep_ids``, else their ids_crc32.
    """
    path = tokenizer_path("word_bpe_49k.json", tokenizer)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        ids_of = id_cache(path, cache_chunks).__getitem__
        ranks: Counter[int] = Counter()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary() if keep_ids else pa.int64(), pa.int32(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids" if keep_ids else "ids_crc32", "task", "local_rank"]
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[] for _ in kinds], kinds)], names=names)
            rows.clear()
            return got

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = b"".join(map(ids_of, chunks(text.as_py() or ""))) + end
                for n, at in enumerate(range(0, len(ids), 4 * width)):
                    part = ids[at : at + 4 * width]
                    size = len(part) // 4
                    rows.append((doc, n, at // 4, size, part if keep_ids else zlib.crc32(part), task, ranks[size]))
                    ranks[size] += 1
                held += len(ids)
                if keep_ids and held > BATCH_BYTES:
                    yield flush()
                    held = 0
            yield flush()
            held = 0

    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(run, f"doc_id long, piece int, start long, length long, {'ids binary' if keep_ids else 'ids_crc32 long'}, task int, local_rank long")


def plan_slots(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: slots (length, first_rank, count, first_sequence, offset).

    Open sequences with the same room are kept as runs of consecutive numbers.
    A length's pieces go where the least room is left that holds them; when none
    is open, new sequences take as many of them as fit.
    """
    room_runs: dict[int, deque[tuple[int, int]]] = {}
    rooms: list[int] = []
    slots: list[tuple[int, int, int, int, int]] = []
    fresh = 0

    def open_run(room: int, first: int, count: int) -> None:
        if room <= 0 or count <= 0:
            return
        if room not in room_runs:
            room_runs[room] = deque()
            insort(rooms, room)
        room_runs[room].append((first, count))

    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = width // length
                full, rest = divmod(left, each)
                for j in range(each):
                    n = full + (j < rest)
                    if full:
                        slots.append((length, rank, full, fresh, j * length))
                        rank += full
                open_run(width - each * length, fresh, full)
                fresh += full
                for j in range(rest):
                    slots.append((length, rank, 1, fresh, j * length))
                    rank += 1
                if rest:
                    open_run(width - rest * length, fresh, 1)
                    fresh += 1
                left = 0
                continue
            room = rooms[i]
            first, count = room_runs[room].popleft()
            if not room_runs[room]:
                del room_runs[room]
                rooms.pop(i)
            n = min(count, left)
            slots.append((length, rank, n, first, width - room))
            open_run(room - length, first, n)
            open_run(room, first + n, count - n)
            left -= n
            rank += n
    return slots


def _slots_of_starts(slots: list[tuple[int, int, int, int, int]], rank_bits: int = 44):
    """Gives the pieces of one length in one task the slots that their ranks, base to base + n, lie in."""
    ordered = sorted(slots)
    keys = np.array([(s[0] << rank_bits) + s[1] for s in ordered], np.int64)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("sequence", pa.int64()), ("offset", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, base, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "base", "n"))
            lo = np.searchsorted(keys, (length << rank_bits) + base, "right") - 1
            hi = np.searchsorted(keys, (length << rank_bits) + base + n - 1, "right")
            found = [[{"first": s[1], "sequence": s[3], "offset": s[4]} for s in ordered[a:b]] for a, b in zip(lo.tolist(), hi.tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("length", "task", "base")), pa.array(found, kind)], names=["length", "task", "base", "slots"])

    return run


def best_fit_packing(docs: DataFrame, *, width: int = WIDTH, end_id: int = END_ID, tokenizer: str | None = None, keep_ids: bool = False, cache_chunks: int | None = None) -> DataFrame:
    """Packs all documents into sequences of at most ``width`` tokens.

    A document is its text's ids without added special tokens, then ``end_id``;
    only documents longer than ``width`` are cut. One row a piece: doc_id,
    piece, start, length, ids_crc32, sequence_id, offset (and ids). A null or
    empty text is its ``end_id`` alone; rows with a null or repeated doc_id are
    packed each for itself; an empty table gives an empty one; columns other
    than doc_id and text are ignored. ``cache_chunks``: how much a worker
    remembers, which changes speed and memory only.
    """
    cut = materialise(pieces(docs, width=width, end_id=end_id, tokenizer=tokenizer, keep_ids=keep_ids, cache_chunks=cache_chunks), "pieces")
    by_task = materialise(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "tasks", few=True)
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``width`` rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"), "n")
    starts = starts.mapInArrow(_slots_of_starts(plan_slots(histogram, width)), "length long, task int, base long, slots array<struct<first: long, sequence: long, offset: long>>")
    starts = materialise(starts, "starts", few=True)
    ranked = cut.join(broadcast_if_small(starts, MOST_STARTS), ["length", "task"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    placed = ranked.withColumn("slot", F.element_at(F.filter("slots", lambda s: s["first"] <= F.col("rank")), -1))
    crc = F.crc32("ids") if keep_ids else F.col("ids_crc32")  # of the ids that lie in their sequence
    sequence = (F.col("slot.sequence") + F.col("rank") - F.col("slot.first")).alias("sequence_id")
    discard(by_task)
    return placed.select("doc_id", "piece", "start", "length", crc.alias("ids_crc32"), *(["ids"] if keep_ids else []), sequence, F.col("slot.offset").alias("offset"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), keep_ids=True).drop("ids")
