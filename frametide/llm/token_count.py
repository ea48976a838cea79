"""Token counts: a map-side lookup in two tiers, without a shuffle.

Tier one is a compact table, pre-token -> number of tokens, of the pre-tokens
that are frequent in the corpus. It has at most ``table_rows`` entries, is built
once and broadcast. All of the corpus is counted for it: each task sends on its
``TASK_ROWS`` most frequent pre-tokens, and these short lists are added up. Tier
two is a bounded cache in each Python worker: what tier one misses is encoded
with the library once and remembered. Counting is then one dictionary lookup a
pre-token, and no text's pre-tokens ever leave their task.

The table only saves time: counts are the library's with any table, also an
empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.llm._common import pick, table
from frametide.llm._words import CACHE_CHARS, ChunkLengths, chunks, tokenizer_path

#: Most entries of the broadcast table, about 2 MB.
TABLE_ROWS = 32_768
#: Most pre-tokens that one task puts forward for it.
TASK_ROWS = 4_096

_CACHES: dict[tuple[str, int], ChunkLengths] = {}


def frequent_lengths(docs: DataFrame, path: str, rows: int = TABLE_ROWS, task_rows: int = TASK_ROWS) -> dict[str, int]:
    """The broadcast tier: token counts of the ``rows`` pre-tokens that tasks put forward most often."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(chunks(text.as_py() or ""))
                if len(seen) > 40 * task_rows:  # lossy counting: the rare ones go
                    seen = Counter(dict(seen.most_common(4 * task_rows)))
        best = [(c, n) for c, n in seen.most_common(task_rows) if len(c) <= CACHE_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["chunk", "n"])

    total = docs.select("text").mapInArrow(top, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    best = total.orderBy(F.desc("n"), "chunk").limit(rows).collect()  # at most ``rows`` rows
    lengths = ChunkLengths(path, {})
    return {r["chunk"]: lengths[r["chunk"]] for r in best}


def _counter(path: str, shared, limit: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, shared.id)
        if key not in _CACHES:
            _CACHES.clear()
            _CACHES[key] = ChunkLengths(path, shared.value)
        length = _CACHES[key].__getitem__
        for batch in batches:
            sizes, counts = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                counts.append(sum(map(length, chunks(text))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return count


class _Shared:
    """A broadcast and its number, which names the worker's cache."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id() if broadcast._jbroadcast is not None else 0

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def token_counts(docs: DataFrame, *, tokenizer: str | None = None, limit: int = 2048, table_rows: int = TABLE_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Counts the tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is the path of a ``word_bpe`` file, word_bpe_49k.json by
    default. Counts are the library's, without added begin or end tokens;
    special strings inside texts count as the library counts them by default.
    A null text counts as empty and gives zeros; rows with a null or repeated
    doc_id are counted each for itself; an empty table gives an empty one;
    columns other than doc_id and text are ignored. ``over_limit``: more than
    ``limit`` tokens.
    """
    path = tokenizer_path("word_bpe_49k.json", tokenizer)
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, table_rows, task_rows)))
    return docs.mapInArrow(_counter(path, shared, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
