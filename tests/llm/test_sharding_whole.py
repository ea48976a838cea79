import struct
import zlib
from collections import Counter

import brute
import pytest
import xxhash
from frametide.llm import sharding
from pyspark.sql import functions as F


@pytest.fixture
def folder(spark, tmp_path):
    rows = brute.awkward_docs()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), rows


def test_op10_digests_come_from_written_texts(spark, folder, monkeypatch):
    path, rows = folder
    wrote = []
    real = sharding.external_shuffle
    monkeypatch.setattr(sharding, "external_shuffle", lambda *a, **b: wrote.append(real(*a, **b)) or wrote[0])
    got = sharding.op10_sharding(spark, path)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got.collect()) == want
    assert Counter((r["doc_id"], r["text"]) for r in wrote[0].collect()) == Counter(rows)
    assert all("/shard=" in f for f in wrote[0].inputFiles())


@pytest.mark.parametrize("repeated", [False, True])
def test_buckets_follow_each_shards_own_bytes(spark, repeated):
    """A key that holds nearly all bytes must not leave its shard's buckets many times too large, nor may a record that repeats."""
    rows = [(7, f"{0 if repeated else i} " + "x" * 500) for i in range(2000)] + [(i, "y") for i in range(100)]
    docs = sharding.with_size(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sharding.external_shuffle(docs, key="doc_id", size="size", bucket_bytes=20_000)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(rows)
    assert max(r["b"] for r in got.groupBy(F.input_file_name()).agg(F.sum("size").alias("b")).collect()) < 2 * 20_000


def hashed(*values, seed=42):
    """Spark's xxhash64: each value's bytes, seeded with the hash so far; nulls change nothing."""
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_shuffle(spark, rows, shards, seed, bucket_bytes):
    """Every record's shard, slot and grown shard, one record at a time."""
    shard_of = lambda doc, n: max((hashed((seed,), (i,), doc), i) for i in range(n))[1]
    held = Counter()
    for doc, text in rows:
        held[shard_of(doc, shards)] += len((text or "").encode()) + 1 + 64
    counts = [max(1, -(-held[s] // bucket_bytes)) for s in range(shards)]
    buckets = {}
    for doc, text in rows:
        s = shard_of(doc, shards)
        buckets.setdefault((s, hashed((seed + 1,), doc, text) % counts[s]), []).append((hashed((seed + 2,), doc, text), doc, text))
    out, at = Counter(), Counter()
    for s, b in sorted(buckets):
        found = sorted(buckets[s, b], key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or ""))
        parts = spark.sparkContext._gateway.new_array(spark._jvm.int, 2)
        parts[0], parts[1] = divmod(seed + sum(counts[:s]) + b, 1 << 32)
        random = spark._jvm.org.apache.commons.math3.random.MersenneTwister(parts)
        order = []
        for i in range(len(found)):  # Fisher-Yates from the inside out
            j = random.nextInt(i + 1)
            order.append(i)
            order[i], order[j] = order[j], i
        for i in order:
            _, doc, text = found[i]
            out[doc, text, s, at[s], shard_of(doc, shards + 1)] += 1
            at[s] += 1
    return out


def test_places_are_those_of_brute_force_under_any_split(spark):
    rows = [r for r in brute.awkward_docs(n=200) if r[0] != 3 or "same id" in r[1]]  # without whole repeats
    seen = []
    for splits, partitions in ((1, "4"), (7, "13")):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        docs = spark.createDataFrame(rows[:: -1 if splits == 7 else 1], "doc_id long, text string").repartition(splits)
        docs = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
        for bucket in (1 << 25, 1500):
            got = sharding.external_shuffle(docs.select("doc_id", "text", "size"), key="doc_id", size="size", shards=5, bucket_bytes=bucket)
            seen.append(Counter((r["doc_id"], r["text"], r["shard"], r["slot"], r["grown_shard"]) for r in got.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[2] and seen[1] == seen[3] and seen[0] != seen[1]


def test_places_are_those_of_brute_force(spark):
    rows = [r for r in brute.awkward_docs(n=200) if r[0] != 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket in (1 << 25, 1500):
        got = sharding.external_shuffle(docs, key="doc_id", size="octet_length(coalesce(text, '')) + 1", shards=5, bucket_bytes=bucket)
        found = Counter((r["doc_id"], r["text"], r["shard"], r["slot"], r["grown_shard"]) for r in got.collect())
        assert found == brute_shuffle(spark, rows, 5, sharding.SEED, bucket)


def test_whole_repeats_are_spread_alike_under_any_split(spark):
    rows = [(None, "z" * 300)] * 500 + [(i, f"t{i}") for i in range(300)]
    seen = []
    for splits in (1, 6):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(splits)
        got = sharding.external_shuffle(sharding.with_size(docs), key="doc_id", size="size", bucket_bytes=10_000).collect()
        seen.append(Counter((r["doc_id"], r["shard"], r["slot"]) for r in got))
    assert seen[0] == seen[1]


def test_slots_are_uniform(spark):
    """Where a record of a shard stands doesn't follow from its id: the rank correlation of ids and slots is near 0."""
    import numpy as np

    docs = sharding.with_size(spark.range(4000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))
    got = sharding.external_shuffle(docs, key="doc_id", size="size", shards=2, bucket_bytes=1 << 15).collect()
    for shard in (0, 1):
        ids, slots = np.array([(r["doc_id"], r["slot"]) for r in got if r["shard"] == shard]).T
        assert 1800 < len(ids) < 2200 and abs(np.corrcoef(ids, slots)[0, 1]) < 0.07
