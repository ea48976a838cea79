"""Sharding by a two-pass external shuffle.

Pass one scatters whole records uniformly into buckets that fit memory, by a
seeded hash of the record. Pass two shuffles each bucket on its own with
Fisher-Yates (Spark's seeded ``shuffle`` of an array) and writes it; a shard is
its buckets one after the other. Records move once. A record's shard is decided
by its key and the number of shards alone, by rendezvous hashing, so one more
shard takes records from all the others evenly and moves no other record.

A bucket is a task of its own, so its shuffle starts from a generator seeded by
the seed and the bucket's number, and from records in a fixed order: slots are
the same however the input is split. Everything runs in the JVM.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frametide.llm._common import discard, materialise, pick, table
from frametide.sources.scratch import scratch_path

SHARDS = 16
SEED = 20_240_607
#: Bytes of records that a bucket holds on average; a task takes one bucket at a time.
BUCKET_BYTES = 32 << 20
#: Records that repeat wholly are dealt over buckets by number once they fill this share of one.
REPEATS_SHARE = 8


def rendezvous(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash with the key is the largest; a null key is a key like any other."""
    return F.greatest(*[F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("h"), F.lit(i).alias("i")) for i in range(shards)])["i"]


def _dealt_keys(spark: SparkSession, n: int) -> DataFrame:
    """(_bucket, _k): for each of ``n`` buckets the least number that hash partitioning into ``n`` sends to the partition of that number."""
    tries = max(64, 4 * n)
    while True:
        drawn = spark.range(tries).select(F.col("id").cast("int").alias("k"))
        found = drawn.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("_bucket")).agg(F.min("k").alias("_k"))
        if found.count() == n:
            return found
        tries *= 2


def _deal_repeats(records: DataFrame, cols: list[str], heavy: DataFrame) -> DataFrame:
    """Records whose ``_h`` is in ``heavy`` (shard, _h, _buckets), one row for each bucket that copies of it go to and how many (_times)."""
    ones = records.join(heavy.select("shard", "_h", "_buckets"), ["shard", "_h"])
    ones = ones.groupBy(*cols, "shard", "grown_shard", "_h", "_buckets").agg(F.count("*").alias("_n"))
    wide = F.least(F.col("_n"), F.col("_buckets")).cast("int")
    dealt = ones.withColumn("_j", F.explode(F.sequence(F.lit(0), wide - 1))).withColumn("_wide", wide)
    times = F.floor(F.col("_n") / F.col("_wide")) + F.when(F.col("_j") < F.col("_n") % F.col("_wide"), 1).otherwise(0)
    return dealt.withColumn("_times", times.cast("int"))


def external_shuffle(records: DataFrame, *, key: str, size: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """Puts all records into shards, in random order within each, written as one folder a shard, and reads them back.

    Adds shard, slot (the place in the shard, gapless from 0) and grown_shard
    (the shard if there were one more). A file is a bucket, a range of its
    shard's slots; names sort in their order. Without ``path`` the files go when
    the driver's JVM ends. ``size`` is a record's bytes, in SQL. Columns of the added
    names are replaced. Records that repeat wholly are placed each for itself; a
    null key is a key like any other; an empty table gives an empty one.
    Shards, slots and grown shards depend on the records, ``shards``, ``seed``
    and ``bucket_bytes`` only.
    """
    spark = records.sparkSession
    cols = [c for c in records.columns if c not in ("shard", "slot", "grown_shard")]
    placed = records.select(*cols, rendezvous(F.col(key), shards, seed).alias("shard"), rendezvous(F.col(key), shards + 1, seed).alias("grown_shard"), F.xxhash64(F.lit(seed + 1), *cols).alias("_h"))
    hashes = placed.groupBy("shard", "_h").agg(F.count("*").alias("_n"), (F.coalesce(F.sum(F.expr(size)), F.lit(0)) + 64 * F.count("*")).alias("_b"))
    hashes = materialise(hashes, "hashes", few=True)  # numbers only: 28 bytes a record
    held = {r["shard"]: int(r["b"]) for r in hashes.groupBy("shard").agg(F.sum("_b").alias("b")).collect()}  # one row a shard
    counts = [max(1, -(-held.get(i, 0) // bucket_bytes)) for i in range(shards)]
    n_buckets = sum(counts)
    first = F.array(*[F.lit(x) for x in [*accumulate(counts, initial=0)][:-1]])
    wide = F.array(*[F.lit(x) for x in counts])
    bucket = lambda j: (first[F.col("shard")] + F.pmod(F.col("_h") + j, wide[F.col("shard")])).cast("int").alias("_bucket")

    repeats = (F.col("_n") > 1) & (F.col("_b") * REPEATS_SHARE > bucket_bytes) & (wide[F.col("shard")] > 1)
    hashes = hashes.withColumns({"_buckets": wide[F.col("shard")], "_many": repeats})
    each = hashes.withColumn("_wide", F.when(F.col("_many"), F.least("_n", "_buckets")).otherwise(1).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_wide") - 1)))
    in_each = F.floor(F.col("_n") / F.col("_wide")) + F.when(F.col("_j") < F.col("_n") % F.col("_wide"), 1).otherwise(0)
    sums = each.select("shard", bucket(F.col("_j")), in_each.alias("_n")).groupBy("shard", "_bucket").agg(F.sum("_n").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    # One row a bucket, a thousand for 30 GB.
    plan = materialise(sums.select("_bucket", F.coalesce(before, F.lit(0)).alias("_base")).join(_dealt_keys(spark, n_buckets), "_bucket"), "buckets", few=True)

    n_repeats = hashes.filter("_many").count()
    if n_repeats:
        heavy = hashes.filter("_many")
        heavy = F.broadcast(heavy) if n_repeats <= 1 << 16 else heavy
        once = placed.join(heavy.select("shard", "_h"), ["shard", "_h"], "left_anti").withColumns({"_times": F.lit(1), "_j": F.lit(0)})
        parts = ["shard", "grown_shard", "_h", *cols, "_times", "_j"]
        scattered = once.select(*parts).unionByName(_deal_repeats(placed, cols, heavy).select(*parts))
    else:
        scattered = placed.withColumns({"_times": F.lit(1), "_j": F.lit(0)})
    record = F.struct(*cols, "grown_shard")
    scattered = scattered.select("shard", bucket(F.col("_j")), "_times", F.struct(F.xxhash64(F.lit(seed + 2), *cols).alias("_o"), record.alias("_r")).alias("_x"))
    scattered = scattered.join(F.broadcast(plan), "_bucket").repartition(n_buckets, "_k")
    lists = scattered.groupBy("_k").agg(F.collect_list(F.struct("_x", "_times") if n_repeats else "_x").alias("_list"), F.first("shard").alias("shard"), F.first("_base").alias("_base"))
    whole = F.flatten(F.transform("_list", lambda e: F.array_repeat(e["_x"], e["_times"]))) if n_repeats else F.col("_list")
    # Sorted first, so that the shuffle starts from the same order however the records arrived.
    dealt = lists.select("shard", "_base", F.shuffle(F.array_sort(whole), seed).alias("_list")).select("shard", "_base", F.posexplode("_list").alias("_pos", "_x"))
    dealt = dealt.select("_x._r.*", "shard", (F.col("_base") + F.col("_pos")).cast("long").alias("slot"))
    out = path or scratch_path(spark, "shards")
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(out)
    discard(hashes, plan)
    return spark.read.schema(dealt.schema).parquet(out).select(*cols, "shard", "slot", "grown_shard")


def with_digests(docs: DataFrame) -> DataFrame:
    """Adds size (the text's UTF-8 bytes, none if it is null, plus 1) and text_crc32 (null counts as empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(F.encode(text, "UTF-8"))})


def with_size(docs: DataFrame) -> DataFrame:
    """doc_id and text, with their digests."""
    return with_digests(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Writes the documents with their texts and digests as one folder a shard under ``path``, and reads them back.

    A shard is several files, each a range of its slots, in the order of their
    names: no task ever writes a whole shard. Null and empty texts, nulls and
    repeats of doc_id, empty tables and clashing columns: as in
    :func:`external_shuffle`, with columns other than doc_id and text left out.
    """
    return external_shuffle(with_size(docs), key="doc_id", size="size", path=path, **options)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are scattered, shuffled and written with their records; size and text_crc32 are those of the texts found in the shards."""
    records = with_size(table(spark, sf_dir, "documents")).select("doc_id", "text", F.col("size").alias("_size"))
    found = with_digests(external_shuffle(records, key="doc_id", size="_size"))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
