"""SimHash near-dedup by a self-join of binary tries.

Fingerprints are 64 majority bits over the XXH64 of word shingles. Fingerprints
within ``MAX_BITS`` differing bits are linked, and documents are grouped by the
links.

The self-join walks pairs of nodes of a binary trie together. A pair carries the
bits in which its two prefixes differ; children on the same side keep that
number, children on opposite sides add one, and a pair that exceeds its error
budget is dropped with all that lies below. Two fingerprints within four bits
have at most one differing bit in some third of the 64, so three tries are
walked, each starting with another third: while inside that third the budget is
``MAX_BITS // 3``, afterwards ``MAX_BITS``. This finds every link, and the walk
stays near linear in the number of fingerprints.

A trie is cut at a depth that follows the number of fingerprints: each pair of
subtrees within the budget is a task's unit, sent to it by its key. A unit that
is still too large is cut deeper, bit by bit, as long as its trie's leading part
goes on; beyond, what shares a whole third is one unit. Inside, what
is already connected is no longer walked (a pair of nodes of one component is
dropped), and only a spanning forest leaves the task: a family of near copies
gives as many rows as it has members, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.llm._common import UID, hex_unsigned, keep_rows, materialise, pick, skew_join, table
from frametide.llm._components import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Where each trie's leading part begins and how many bits it has.
PARTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of a subtree that one task takes, on average.
BLOCK = 16_384
#: A unit of more fingerprints is split by further bits.
MOST = 1 << 18

_FRONTIER = 200_000
_LEAF_PAIRS = 64


def count_bits(words: np.ndarray) -> np.ndarray:
    """How many rows of 64-bit words set each bit, from the highest bit of the first word on."""
    raw = words.astype(">u8").view(np.uint8).reshape(len(words), -1)
    counts = np.zeros(8 * raw.shape[1], np.int64)
    for at in range(0, len(raw), 255):  # sums of so many bits fit a byte
        counts += np.unpackbits(raw[at : at + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return counts


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a text; 0 if it has no words."""
    words = text.encode().lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    if len(words) < shingle:
        return int.from_bytes(digest(joined, seed), "big")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    counts = np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    tails = ends[shingle - 1 :].tolist()
    for at in range(0, n, 1 << 16):
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], tails[at : at + (1 << 16)])])
        counts += count_bits(np.frombuffer(raw, ">u8")[:, None])
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) and the row's number, if it has one."""
    keep = [c for c in ("doc_id", UID) if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([_signed(fingerprint(t.as_py() or "")) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), fps], names=[*keep, "fp"])

    docs = pick(docs, *keep, "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in keep) + ", fp long")


class Forest:
    """Union-find over positions, with whole arrays at a time."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.steps = np.zeros(n, np.int64)
        self._count()

    def _count(self) -> None:
        self.steps[1:] = np.cumsum(self.label[1:] != self.label[:-1])

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        changed = False
        while len(x):
            a, b = self.label[x], self.label[y]
            differ = a != b
            if not differ.any():
                break
            changed = True
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up
        if changed:
            self._count()

    def joined(self, lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
        """Which pairs of ranges lie within one component."""
        label, steps = self.label, self.steps
        return (label[lo1] == label[lo2]) & (steps[lo1] == steps[hi1 - 1]) & (steps[lo2] == steps[hi2 - 1])


def trie_links(a: np.ndarray, b: np.ndarray | None, depth: int, err: int, part_bits: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """Component labels of sorted distinct unsigned values, by position in ``a`` then ``b``.

    All of ``a`` share their first ``depth`` bits, all of ``b`` too, and the two
    prefixes differ in ``err`` bits; ``b`` None: ``a`` with itself.
    """
    part_budget = max_bits // len(PARTS)
    alone = b is None
    values = a if alone else np.concatenate([a, b])
    shift = 0 if alone else len(a)
    b = a if alone else b
    forest = Forest(len(values))
    for base, side in ((0, a),) if alone else ((0, a), (shift, b)):  # neighbours in order, which connects most of a dense family at once
        near = np.flatnonzero(np.bitwise_count(side[1:] ^ side[:-1]) <= max_bits)
        forest.link(base + near, base + near + 1)
    one = lambda x: np.array([x], np.int64)
    stack = [(depth, one(0), one(len(a)), one(0), one(len(b)), one(err))]
    while stack:
        depth, lo1, hi1, lo2, hi2, err_ = stack.pop()
        if len(lo1) > _FRONTIER:
            for at in range(0, len(lo1), _FRONTIER):
                stack.append((depth, *(x[at : at + _FRONTIER] for x in (lo1, hi1, lo2, hi2, err_))))
            continue
        keep = (hi1 > lo1) & (hi2 > lo2) & (err_ <= (part_budget if depth <= part_bits else max_bits))
        lo1, hi1, lo2, hi2, err_ = (x[keep] for x in (lo1, hi1, lo2, hi2, err_))
        if not len(lo1):
            continue
        keep = ~forest.joined(lo1, hi1, lo2 + shift, hi2 + shift)
        lo1, hi1, lo2, hi2, err_ = (x[keep] for x in (lo1, hi1, lo2, hi2, err_))
        size = (hi1 - lo1) * (hi2 - lo2)
        leaf = (size <= _LEAF_PAIRS) | (depth == 64)
        if leaf.any():
            l1, l2, n2, count = lo1[leaf], lo2[leaf], (hi2 - lo2)[leaf], size[leaf]
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            width = np.repeat(n2, count)
            x, y = np.repeat(l1, count) + k // width, np.repeat(l2, count) + k % width
            if alone:
                x, y = x[x < y], y[x < y]
            close = np.bitwise_count(a[x] ^ b[y]) <= max_bits
            forest.link(x[close], y[close] + shift)
            lo1, hi1, lo2, hi2, err_ = (z[~leaf] for z in (lo1, hi1, lo2, hi2, err_))
        if not len(lo1):
            continue
        bit = np.uint64(63 - depth)
        ones = np.uint64((1 << 64) - (1 << (64 - depth)) if depth else 0)
        half = np.uint64(1) << bit
        mid1 = np.searchsorted(a, (a[lo1] & ones) | half)
        mid2 = np.searchsorted(b, (b[lo2] & ones) | half)
        same = (lo1 == lo2) & (hi1 == hi2) if alone else np.zeros(len(lo1), bool)
        other = ~same
        parts = [
            (lo1, mid1, lo2, mid2, err_),
            (mid1, hi1, mid2, hi2, err_),
            (lo1, mid1, mid2, hi2, err_ + 1),
            tuple(z[other] for z in (mid1, hi1, lo2, mid2, err_ + 1)),
        ]
        stack.append((depth + 1, *(np.concatenate(z) for z in zip(*parts))))
    return forest.label


def _rotate(value: Column, bits: int) -> Column:
    return value if not bits else F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, 64 - bits))


_UNIT = ["part", "depth", "low", "bit"]


def _units(distinct: DataFrame, depth: int) -> DataFrame:
    """Each fingerprint in every unit that it belongs to at one depth: a trie (part), the lesser of two prefixes of that many bits, the bit in which the other differs (-1: none, the subtree with itself), its side and its rotated value."""
    top = lambda c: F.shiftrightunsigned(c, 64 - depth) if depth else F.lit(0).cast("long")
    units = []
    for part, (start, _) in enumerate(PARTS):
        value = _rotate(F.col("fp"), start)
        prefix = top(value)
        unit = lambda low, bit, side: F.struct(low.alias("low"), F.lit(bit).alias("bit"), side.alias("side"))
        own = [unit(prefix, -1, F.lit(0))]
        for bit in range(depth):
            flip = F.lit(1 << bit).cast("long")
            own.append(unit(prefix.bitwiseAND(F.bitwise_not(flip)), bit, F.when(prefix.bitwiseAND(flip) == 0, 0).otherwise(1)))
        units.append(distinct.select(F.lit(part).alias("part"), F.lit(depth).alias("depth"), value.alias("value"), F.explode(F.array(*own)).alias("x")).select("part", "depth", "x.*", "value"))
    return units[0].unionByName(units[1]).unionByName(units[2])


def _one_deeper(rows: DataFrame) -> DataFrame:
    """The rows of units in the units below them: a subtree with itself is its two halves with themselves and with each other; of two subtrees, only halves on the same side are left within the budget."""
    beta = F.getbit("value", F.lit(63) - F.col("depth")).cast("long")
    twice = F.col("low") * 2
    unit = lambda low, bit, side: F.struct(low.alias("low"), bit.cast("int").alias("bit"), side.cast("int").alias("side"))
    below = F.when(F.col("bit") < 0, F.array(unit(twice + beta, F.lit(-1), F.lit(0)), unit(twice, F.lit(0), beta))).otherwise(F.array(unit(twice + beta, F.col("bit") + 1, F.col("side"))))
    return rows.select("part", (F.col("depth") + 1).alias("depth"), "value", F.explode(below).alias("x")).select("part", "depth", "x.*", "value")


def _split(rows: DataFrame, depth: int, most: int) -> DataFrame:
    """The rows with units of more than ``most`` fingerprints replaced by the units below them, while their trie's leading part goes on."""
    done: list[DataFrame] = []
    lengths = F.array(*[F.lit(bits) for _, bits in PARTS])
    while depth < max(bits for _, bits in PARTS):
        large = rows.groupBy(*_UNIT).agg(F.count("*").alias("n")).filter((F.col("n") > most) & (F.col("depth") < lengths[F.col("part")]))
        large = materialise(large.drop("n"), "large", few=True)
        if large.isEmpty():
            break
        done.append(rows.join(large, _UNIT, "left_anti"))
        rows = materialise(_one_deeper(rows.join(large, _UNIT, "left_semi")), "split")
        depth += 1
    for more in done:
        rows = rows.unionByName(more)
    return rows


def links(distinct: DataFrame, n: int, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """Edges (u, v) that connect just the distinct fingerprints (column fp) that a chain of links connects."""
    depth = 0
    while depth < 20 and (n >> depth) > block:
        depth += 1
    rows = _units(distinct, depth)
    # Two prefixes make a unit: none is larger than twice the most that one prefix has.
    prefixes = _units(distinct, depth).filter("bit = -1").groupBy("part", "low").agg(F.count("*").alias("n"))
    if 2 * (prefixes.agg(F.max("n")).first()[0] or 0) > most:
        rows = _split(rows, depth, most)

    def walk(key: tuple, got: pa.Table) -> pa.Table:
        part, depth, _, bit = (k.as_py() for k in key)
        start, bits = PARTS[part]
        value = got.column("value").to_numpy().view(np.uint64)
        side = got.column("side").to_numpy()
        a, b = np.sort(value[side == 0]), np.sort(value[side == 1])
        if bit < 0:
            values, label = a, trie_links(a, None, depth, 0, bits)
        elif len(a) and len(b):
            values, label = np.concatenate([a, b]), trie_links(a, b, depth, 1, bits)
        else:
            values = label = np.zeros(0, np.int64)
        found = np.flatnonzero(label != np.arange(len(label)))
        back = lambda x: (x if not start else (x >> np.uint64(start)) | (x << np.uint64(64 - start))).view(np.int64)
        if not len(found):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        return pa.table({"u": pa.array(back(values[found])), "v": pa.array(back(values[label[found]]))})

    return rows.groupBy(*_UNIT).applyInArrow(walk, "u long, v long")


def fingerprint_groups(fps: DataFrame) -> DataFrame:
    """One row for each distinct fp of a written table: fp, n_rows, component_id (smallest doc_id reachable), keep_uid."""
    has_uid = UID in fps.columns
    uid = F.col(UID) if has_uid else F.lit(0).cast("long")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", uid.alias("uid")))
    distinct = materialise(fps.groupBy("fp").agg(F.count("*").alias("n_rows"), best.alias("best")), "distinct", few=True)
    stars = components(links(distinct.select("fp"), distinct.count()), "stars")
    placed = distinct.join(stars.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("v", "fp")).drop("v")
    placed = materialise(placed, "placed", few=True)
    roots = placed.groupBy("root").agg(F.min("best").alias("least"), F.count("*").alias("n_fps"))
    joined = skew_join(placed.select("fp", "n_rows", "root"), materialise(roots, "roots", few=True), ["root"], "n_fps", placed.count(), ["fp"])
    return joined.select("fp", "n_rows", F.col("least.doc_id").alias("component_id"), F.col("least.uid").alias("keep_uid"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """Groups documents by chains of links: doc_id, fingerprint (16 hexadecimal digits), component_id, kept.

    Words are runs of anything but ASCII white space, A-Z in lower case; a text
    of fewer than four is one shingle; a null, empty or blank text has
    fingerprint zero, linked like any other. component_id is the smallest doc_id
    reachable, null if all of them are. ``kept`` is set for one row of each
    group, the one of component_id, or the first of several. Rows that repeat
    are grouped each for itself; an empty table gives an empty one; other
    columns are ignored.
    """
    rows = docs if UID in docs.columns else pick(docs, "doc_id", "text").withColumn(UID, F.monotonically_increasing_id())
    fps = materialise(fingerprints(rows), "fingerprints")
    groups = materialise(fingerprint_groups(fps), "groups", few=True)
    joined = skew_join(fps, groups, ["fp"], "n_rows", fps.count(), [UID])
    return joined.select("doc_id", hex_unsigned(F.col("fp")).alias("fingerprint"), "component_id", (F.col(UID) == F.col("keep_uid")).alias("kept"), UID)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of :func:`simhash_groups`, with all its columns, whatever their names.

    Nulls, blanks, ties, repeats and empty tables: as in :func:`simhash_groups`.
    """
    return keep_rows(docs, simhash_groups)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).drop(UID)
