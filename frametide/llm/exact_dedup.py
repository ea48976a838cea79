"""Exact dedup: tree-merge of sorted digest runs.

Every partition turns its texts into a run of digests sorted by SHA-256 and
merges equal ones. Then partitions exchange runs in binomial rounds, as in a
recursive-halving reduce-scatter: in round r a partition keeps the digests whose
r-th base-``FAN`` digit is its own and sends the others to its ``FAN - 1``
partners, which differ from it in that digit only. A receiver merges its ``FAN``
sorted runs, keeping for each digest the row that stays. After the last round a
partition's number is decided by the digest alone and every digest is in one
place. A group of copies, however large, is one row of a run from the first
local merge on, so no task ever holds more than one row a group and partner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.llm._common import SPACES, UID, keep_rows, materialise, pick, shuffle_partitions, skew_join, table

#: Runs that meet in one merge.
FAN = 4

KEY = ["text_sha256", "check64", "norm_bytes"]
RUN = "text_sha256 string, check64 long, norm_bytes long, n_rows long, keep_chars long, keep_id long, keep_uid long"
_DELETE = SPACES.encode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text in batch.column("text"):
            raw = text.as_py() or ""
            norm = raw.encode().translate(None, _DELETE)
            for column, value in zip(out, (len(raw), hashlib.sha256(norm).hexdigest(), xxhash.xxh64_intdigest(norm) - (1 << 63), len(norm))):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column(UID), *(pa.array(c, pa.string() if i == 1 else pa.int64()) for i, c in enumerate(out))],
            names=["doc_id", "uid", "n_chars", "text_sha256", "check64", "norm_bytes"],
        )


def digest_table(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_chars (code points of the original), the digest columns of ``KEY``, uid.

    ``uid`` numbers rows, so that repeated rows can be told apart; it is only
    stable once the table is written.
    """
    numbered = pick(docs, "doc_id", "text", UID) if UID in docs.columns else pick(docs, "doc_id", "text").withColumn(UID, F.monotonically_increasing_id())
    return numbered.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        _digests, "doc_id long, uid long, n_chars long, text_sha256 string, check64 long, norm_bytes long"
    )


def _better(a: tuple, b: tuple) -> tuple:
    """Of (chars, id, uid): most code points, then smallest id (null last), then smallest uid."""
    if a[0] != b[0]:
        return a if a[0] > b[0] else b
    if a[1] != b[1]:
        if a[1] is None or b[1] is None:
            return b if a[1] is None else a
        return a if a[1] < b[1] else b
    return a if a[2] <= b[2] else b


def _merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by digest and makes one of those whose whole key agrees.

    Rows of one SHA-256 stand together; those whose second hash or length
    differ are kept apart, so a digest collision cannot merge two texts.
    """
    names = ["text_sha256", "check64", "norm_bytes", "n_rows", "keep_chars", "keep_id", "keep_uid"]
    types = [pa.string(), *[pa.int64()] * 6]
    open_sha: str | None = None
    group: dict[tuple, list] = {}
    out: list[tuple] = []

    def close() -> None:
        out.extend((*key, n, *best) for key, (n, best) in group.items())
        group.clear()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        for sha, check, size, n, chars, doc, uid in zip(*(batch.column(c).to_pylist() for c in names)):
            if sha != open_sha:
                close()
                open_sha = sha
            got = group.get(key := (sha, check, size))
            if got is None:
                group[key] = [n, (chars, doc, uid)]
            else:
                got[0] += n
                got[1] = _better(got[1], (chars, doc, uid))
        if len(out) >= 4096:
            yield batch_of(out)
            out.clear()
    close()
    if out:
        yield batch_of(out)


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the sorted runs that a partition was sent, which arrive one after the other.

    A stable merge sort finds the runs in its input and merges them; what is
    already in order is only read. Held are the partition's runs: a row a digest
    and run, however many copies a text has.
    """
    got = list(batches)
    if not got:
        return
    runs = pa.Table.from_batches(got)
    order = np.argsort(np.array(runs.column("text_sha256").to_pylist(), "S64"), kind="stable")
    yield from _merge_sorted(b for at in range(0, len(order), 8192) for b in runs.take(order[at : at + 8192]).to_batches())


def merge_runs(digests: DataFrame, fan: int = FAN) -> DataFrame:
    """One row for each distinct text: ``KEY``, n_rows, keep_chars, keep_id, keep_uid."""
    spark = digests.sparkSession
    rounds = 1
    while fan**rounds < shuffle_partitions(spark):
        rounds += 1
    slots = fan**rounds
    runs = (
        digests.select(*KEY, F.lit(1).cast("long").alias("n_rows"), F.col("n_chars").alias("keep_chars"), F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"))
        .sortWithinPartitions("text_sha256")
        .mapInArrow(_merge_sorted, RUN)
        .withColumn("slot", F.spark_partition_id() % slots)
    )
    home = F.pmod(F.xxhash64("text_sha256"), F.lit(slots)).cast("int")
    for r in range(rounds):
        unit = fan**r
        digit = lambda c, unit=unit: F.floor(c / unit).cast("int") % fan
        runs = runs.withColumn("slot", (F.col("slot") + (digit(home) - digit(F.col("slot"))) * unit).cast("int"))
        runs = (
            runs.repartitionById(slots, F.col("slot"))
            .select(*[c.split()[0] for c in RUN.split(", ")])
            .mapInArrow(_merge_runs, RUN)
            .withColumn("slot", F.spark_partition_id())
        )
    return runs.drop("slot")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Decides for every row of ``docs`` (doc_id, text) whether it stays.

    Texts are equal when identical after deleting ASCII white space; a null text
    counts as empty. Of equal texts the row with the most code points stays, of
    those the one with the smallest doc_id (a null doc_id is larger than any);
    of rows that repeat wholly, exactly one. Columns: doc_id, keep_id,
    group_size, kept, text_sha256, n_chars, uid (the row's number; that of
    column ``UID`` if ``docs`` has it). An empty table gives an empty one;
    columns other than doc_id and text are ignored.
    """
    digests = materialise(digest_table(docs), "digests")
    groups = materialise(merge_runs(digests), "groups", few=True)
    joined = skew_join(digests, groups.withColumn("group_size", F.col("n_rows")), KEY, "n_rows", digests.count(), ["uid"])
    return joined.select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256", "n_chars", "uid"
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns, whatever their names.

    Nulls, blanks, ties, repeats and empty tables: as in :func:`exact_dedup`.
    """
    return keep_rows(docs, lambda rows: exact_dedup(rows).select(F.col("uid").alias(UID), "kept"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("uid")


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256, n_chars FROM r
"""
