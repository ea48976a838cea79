"""Shared plumbing of the training-data operators.

Nothing outside this subpackage imports it. ``materialise`` writes a table to
the folder that ``spark.checkpoint.dir`` names and reads it back: what follows
survives lost executors without computing it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.sources.scratch import discard, written  # noqa: F401

#: ASCII white space, the separators of every word rule in this subpackage.
SPACES = " \t\n\x0b\x0c\r"

#: Column that numbers the rows of documents.
UID = "frametide_row_uid"
#: Most files whose names are broadcast to number their rows, and most row numbers, 8 bytes each, that are.
MOST_FILES, MOST_BROADCAST = 20_000, 1 << 20


#: Rows of an Arrow batch: texts are long, and both sides hold a batch of each task.
ARROW_ROWS = 2_000


def materialise(df: DataFrame, label: str, *, few: bool = False) -> DataFrame:
    """``df`` as a written table (see ``written``), by Arrow batches of at most ``ARROW_ROWS`` rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(min(int(before), ARROW_ROWS) if int(before) > 0 else ARROW_ROWS))
    try:
        return written(df, label, few=few)
    finally:
        conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact, case-sensitive name, the first of any repeats.

    Extra columns, also those that differ from a wanted one in case only or
    repeat its name, are left out and never make a reference ambiguous.
    """
    cols = df.columns
    missing = [n for n in names if n not in cols]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {cols}")
    plain = df.toDF(*[f"_c{i}" for i in range(len(cols))])
    return plain.select(*[F.col(f"_c{cols.index(n)}").alias(n) for n in names])


def filter_arrow(docs: DataFrame, run: Callable) -> DataFrame:
    """The rows that ``run``, a function of record batches, passes on, whatever the columns' names."""
    cols = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(cols))])
    return plain.mapInArrow(run, plain.schema).toDF(*cols)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``UID``, the same number for a row in every reading.

    Where ``docs`` is read straight from files, that is the file's place among
    its files and the row's place in it, and nothing is written. Anything else
    is numbered in a written copy.
    """
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    known = "_metadata" not in [c.lower() for c in docs.columns]  # a column of that name hides what Spark knows of files
    if known and docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        place = plain.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        files = sorted(r["_file"] for r in place.select("_file").distinct().limit(MOST_FILES + 1).collect())  # reads footers only
        if 0 < len(files) <= MOST_FILES:
            numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), "_no long, _file string")
            return place.join(F.broadcast(numbers), "_file").withColumn(UID, F.shiftleft("_no", 40) + F.col("_row")).drop("_file", "_row", "_no")
    return materialise(plain.withColumn(UID, F.monotonically_increasing_id()), "numbered")


def keep_rows(docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``decide`` keeps, with all their columns, whatever their names.

    Rows are numbered, so that rows which repeat wholly can be told apart.
    ``decide`` gets doc_id, text and ``UID`` and returns ``UID`` and kept for each
    row. The numbers of the rows that go are broadcast if they are at most
    ``MOST_BROADCAST``: then texts don't move. Beyond that both sides are
    shuffled.
    """
    cols = docs.columns
    plain = _numbered(docs)
    view = plain.select(*[F.col(f"_c{cols.index(n)}").alias(n) for n in ("doc_id", "text")], UID)
    gone = materialise(decide(view).filter("NOT kept").select(UID), "gone", few=True)
    return plain.join(broadcast_if_small(gone), UID, "left_anti").drop(UID).toDF(*cols)


def broadcast_if_small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``most`` rows; beyond that it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: At most so many keys are heavy in a ``skew_join``.
HEAVY_KEYS = 2048


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, spread: list[str], weights: DataFrame | None = None) -> DataFrame:
    """Inner join of many rows with a table that has few rows a key, whatever share of the rows one key holds.

    ``weight`` counts a key's left rows, ``total`` all of them. It is a column of
    ``right``, which then has each key once, or of ``weights``, which has each
    key once instead. Keys with more than ``total / HEAVY_KEYS`` rows number fewer
    than ``HEAVY_KEYS``; only these keys are broadcast, so the bound holds at any
    size. A heavy key's right rows are repeated once for each such share of left
    rows, and its left rows are dealt over the repeats by a hash of ``spread``.
    The result has the columns of both sides, the keys once, without ``weight``.
    Null keys match nothing.
    """
    limit = max(64, -(-total // HEAVY_KEYS))
    copies = F.greatest(F.ceil(F.col(weight) / F.lit(limit)), F.lit(1)).cast("int")
    heavy = F.broadcast((right if weights is None else weights).filter(F.col(weight) > limit).select(*keys, copies.alias("_copies")))
    dealt = left.join(heavy, keys, "left")
    salt = F.when(F.col("_copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_copies")).cast("int"))
    if weights is not None:
        right, copies = right.join(heavy, keys, "left"), F.coalesce("_copies", F.lit(1))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop(weight, "_copies")
    return dealt.withColumn("_salt", salt).drop("_copies").join(repeated, [*keys, "_salt"]).drop("_salt")


def hex_unsigned(col: Column) -> Column:
    """A long's 64 bits as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))
