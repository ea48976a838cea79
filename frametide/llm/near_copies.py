"""SimHash near-dedup at a similarity: the pipeline's stage.

``op6_simhash_dedup`` has a contract of its own, 64 bits and at most 4 of them
differing, which finds few copies of a similarity of 0.8: there 10 bits differ.
Here a text's fingerprint is ``WORDS`` 64-bit words of majority bits over its
5-word shingles, and two texts are linked if their fingerprints differ in at most
``budget()`` bits, about what a Jaccard similarity of 0.8 gives.

A budget of a seventh of all bits prunes a trie only far below its leading bits:
sent by prefix, as op6 does it, each fingerprint would go to hundreds of tasks.
So links are found in two passes, of which the second loses none:

1. Texts meet in buckets: those that agree in one of ``BANDS`` bands of ``ROWS``
   minimum hashes of their shingles. Inside a bucket the tries are joined with
   themselves: pairs of nodes are walked together, differing bits add up, and a
   pair is dropped once the budget is passed or all below it is connected. Only a
   spanning forest leaves a bucket, so a family of near copies gives as many rows
   as it has members, not pairs.
2. What meets in no bucket: every fingerprint is held against all that aren't in
   its component yet, block by block. Of 162 differing bits in 54 parts some part
   has three, so fingerprints within 161 bits differ in at most two bits of some
   part: parts are looked up under all masks of up to two bits, and what is found
   is held against the budget, first on two parts together, then on all bits.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frametide.llm._common import UID, discard, keep_rows, materialise, pick, skew_join
from frametide.llm._components import components
from frametide.llm.simhash_dedup import Forest, count_bits

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
WORDS = 16
BANDS, ROWS = 24, 5
#: Fingerprints of one bucket that a task holds at a time, twice; larger buckets are joined block by block.
BLOCK = 65_536
#: The second pass deals ``n`` fingerprints into ``sqrt(n / SHARE)`` blocks, at most ``MOST_BLOCKS``: a task holds two.
SHARE, MOST_BLOCKS = 8_192, 40

_RANDOM = np.random.default_rng(SEED)
_FLIP = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
_ODD = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RANDOM.integers(0, 1 << 63, (3, WORDS), np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 1024
_LEAF_PAIRS = 1 << 17
#: Bits of a part that are looked up, bits in which it may differ, candidates that are held at a time, and runs that are worth a round.
_KEY_BITS, _PART_BITS, _PIECE, _MANY = 19, 2, 1 << 20, 1 << 12


def budget(similarity: float = SIMILARITY, words: int = WORDS) -> int:
    """Differing bits up to which two texts are linked: what sets of one size and of that Jaccard similarity give on average, and half a standard deviation."""
    bits, share = 64 * words, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + 0.5 * math.sqrt(bits * share * (1 - share)))


def shingles(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The sorted distinct XXH64 of a text's shingles; a text of fewer words is one, a blank one has none."""
    words = text.encode().lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64))


def buckets(found: np.ndarray) -> np.ndarray:
    """The bucket of a set of shingles in each band, as longs."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), _STEP):
        np.minimum(least, ((found[at : at + _STEP] ^ _FLIP) * _ODD).min(axis=1), out=least)
    raw, width = least.tobytes(), 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[i * width : (i + 1) * width], i) for i in range(BANDS)], np.uint64).view(np.int64)


def spread(found: np.ndarray) -> np.ndarray:
    """``WORDS`` words of independent bits for each shingle's hash."""
    x = found[:, None] * _MIX[0]
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    return (x ^ (x >> np.uint64(29))) * _MIX[2] ^ (x >> np.uint64(32))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """Big-endian bytes of the ``WORDS`` words: a bit is 1 if set in over half of the shingles; all 0 without any."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(found), 1 << 14):
        counts += count_bits(spread(found[at : at + (1 << 14)]))
    return np.packbits(2 * counts > len(found))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py() or "") for t in batch.column("text")]
        fps = [fingerprint(s).tobytes() for s in sets]
        met = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(sets) + 1, BANDS), pa.int32()), pa.array(np.concatenate([buckets(s) for s in sets]) if sets else [], pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(UID), pa.array(fps, pa.binary()), met], names=["doc_id", UID, "fp", "met"])


def wide_links(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """Component labels, by position, of sorted fingerprints: rows of big-endian words read as uint64."""
    m, words = fps.shape
    forest = Forest(m)
    differ = lambda x, y: np.bitwise_count(fps[x] ^ fps[y]).sum(axis=1, dtype=np.int64)
    near = np.flatnonzero(differ(np.arange(1, m), np.arange(m - 1)) <= max_bits)  # neighbours in order, which connects most of a family at once
    forest.link(near, near + 1)
    one = lambda x: np.array([x], np.int64)
    stack = [(0, one(0), one(m), one(0), one(m), one(0))]
    while stack:
        depth, lo1, hi1, lo2, hi2, err = stack.pop()
        keep = (hi1 > lo1) & (hi2 > lo2) & (err <= max_bits)
        lo1, hi1, lo2, hi2, err = (x[keep] for x in (lo1, hi1, lo2, hi2, err))
        if not len(lo1):
            continue
        keep = ~forest.joined(lo1, hi1, lo2, hi2)
        lo1, hi1, lo2, hi2, err = (x[keep] for x in (lo1, hi1, lo2, hi2, err))
        leaf = ((hi1 - lo1) * (hi2 - lo2) <= _LEAF_PAIRS) | (depth == 64 * words)
        for a, b, c, d in zip(*(x[leaf].tolist() for x in (lo1, hi1, lo2, hi2))):
            label = forest.label  # looked at again for each leaf: the one before may have connected it
            if (a, b) != (c, d) and (label[a:b] == label[a]).all() and (label[c:d] == label[a]).all():
                continue
            rows = max(1, _LEAF_PAIRS // (d - c))
            for at in range(a, b, rows):
                x, y = np.nonzero(np.bitwise_count(fps[at : min(at + rows, b), None] ^ fps[None, c:d]).sum(axis=2, dtype=np.int64) <= max_bits)
                forest.link(x + at, y + c)
        lo1, hi1, lo2, hi2, err = (x[~leaf] for x in (lo1, hi1, lo2, hi2, err))
        if not len(lo1):
            continue
        word, bit = divmod(depth, 64)
        ones = np.concatenate([[0], np.cumsum((fps[:, word] >> np.uint64(63 - bit)) & np.uint64(1))]).astype(np.int64)
        mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        other = (lo1 != lo2) | (hi1 != hi2)
        parts = [(lo1, mid1, lo2, mid2, err), (mid1, hi1, mid2, hi2, err), (lo1, mid1, mid2, hi2, err + 1), tuple(z[other] for z in (mid1, hi1, lo2, mid2, err + 1))]
        stack.append((depth + 1, *(np.concatenate(z) for z in zip(*parts))))
    return forest.label


def _walk(max_bits: int):
    """From members sorted by unit: the spanning forest of each unit's links, (u, v) by node."""

    def links(nodes: list[np.ndarray], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, fps = np.concatenate(nodes), np.frombuffer(b"".join(raw), ">u8").reshape(-1, WORDS).astype(np.uint64)
        order = np.lexsort(fps.T[::-1])
        ids, label = ids[order], wide_links(fps[order], max_bits)
        found = np.flatnonzero(label != np.arange(len(label)))
        return ids[found], ids[label[found]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nodes, raw = None, [], []
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> None:
            if sum(map(len, nodes)) > 1:
                out.append(links(nodes, raw))
            nodes.clear()
            raw.clear()

        def batch_of() -> pa.RecordBatch:
            u, v = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in (0, 1))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "low", "high")])
            ids = batch.column("node").to_numpy()
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if (now := tuple(keys[:, a].tolist())) != unit:
                    close()
                    unit = now
                nodes.append(ids[a:b])
                raw.append(b"".join(batch.column("fp").slice(a, b - a).to_pylist()))
            if len(out) > 4096:
                yield batch_of()
        close()
        yield batch_of()

    return run


def _edges(distinct: DataFrame, max_bits: int, block: int) -> DataFrame:
    """Edges (u, v) that connect just the nodes of a written table (node, fp, met) that a chain of links within buckets connects."""
    met = distinct.select("node", F.explode("met").alias("bucket"))
    shared = met.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    members = skew_join(met, materialise(shared, "shared", few=True), ["bucket"], "n", BANDS * distinct.count(), ["node"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = members.select("node", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    rows = units.join(distinct.select("node", "fp"), "node")
    return rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").select("bucket", "low", "high", "node", "fp").mapInArrow(_walk(max_bits), "u long, v long")


def parts(bits: int, max_bits: int) -> list[tuple[int, int]]:
    """An even number of ranges of at most 32 bits. Fingerprints that differ in more than ``_PART_BITS`` bits of each, or in more than twice that and one of each two, differ in more than ``max_bits``."""
    n = 2 * (max_bits // (2 * _PART_BITS + 2) + 1)
    starts = [bits * i // n for i in range(n + 1)]
    return [(a, min(b, a + 32)) for a, b in zip(starts, starts[1:])]


def _take(fps: np.ndarray, first: int, last: int) -> np.ndarray:
    """Bits ``first`` to ``last``, without it, of each row of words."""
    word, bit = divmod(first, 64)
    value = fps[:, word] << np.uint64(bit)
    if last > 64 * (word + 1):
        value |= fps[:, word + 1] >> np.uint64(64 - bit)
    return value >> np.uint64(64 - (last - first))


def _expand(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Position i ``counts[i]`` times with 0, 1, ... beside it, by pieces of at most ``_PIECE`` and one position's."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PIECE, "right")))
        n = counts[at:stop]
        yield np.repeat(np.arange(at, stop), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = stop


class _Runs:
    """Rows in order of a key, cut into runs of one key and one label."""

    def __init__(self, rows: np.ndarray, key: np.ndarray, label: np.ndarray, both: np.ndarray, width: int):
        order = np.argsort((key[rows] << 40) | label[rows])
        self.rows = rows[order]
        self.both = both[self.rows]
        k, v = key[self.rows], label[self.rows]
        self.first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])]))
        self.size = np.diff(np.append(self.first, len(k)))
        self.key, self.label = k[self.first].astype(np.int32), v[self.first]
        #: The first run of each key, and whether there is one.
        self.begin = np.searchsorted(self.key, np.arange((1 << width) + 1, dtype=np.int32)).astype(np.int32)
        self.has = self.begin[1:] > self.begin[:-1]
        self.single = len(self.first) == len(k)


def _run_pairs(left: _Runs, right: _Runs, mask: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs whose keys differ in just the bits of ``mask``; of a table with itself each pair once."""
    target = left.key ^ np.int32(mask)
    if left is not right:
        hit = np.flatnonzero(right.has[target])
        lo = right.begin[target[hit]]
    elif mask:
        hit = np.flatnonzero(right.has[target] & (left.key < target))
        lo = right.begin[target[hit]]
    else:
        hit = np.arange(len(target))
        lo = hit + 1
    end = right.begin[target[hit] + 1]
    while len(hit) > _MANY:  # most keys have few runs, which are taken one after the other
        more = lo < end
        hit, lo, end = hit[more], lo[more], end[more]
        yield hit, lo
        lo = lo + 1
    for i, k in _expand(end - lo):
        yield hit[i], lo[i] + k


def _candidates(left: _Runs, right: _Runs, mask: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of differing labels whose keys differ in just the bits of ``mask``, both parts together in few enough."""
    most = 2 * _PART_BITS + 1
    for a, b in _run_pairs(left, right, mask):
        if left.single and right.single:
            near = np.flatnonzero(np.bitwise_count(left.both[a] ^ right.both[b]) <= most)
            a, b = a[near], b[near]
            apart = left.label[a] != right.label[b]
            yield left.rows[a[apart]], right.rows[b[apart]]
            continue
        apart = left.label[a] != right.label[b]
        a, b = a[apart], b[apart]
        for i, k in _expand(left.size[a]):
            x, of = left.first[a][i] + k, b[i]
            for i, k in _expand(right.size[of]):
                y = right.first[of][i] + k
                near = np.flatnonzero(np.bitwise_count(left.both[x[i]] ^ right.both[y]) <= most)
                yield left.rows[x[i][near]], right.rows[y[near]]


def rest_links(fps: np.ndarray, label: np.ndarray, max_bits: int, cut: int = 0) -> np.ndarray:
    """``label`` with all components joined that a link connects: fingerprints as rows of words, labels the least position of each component.

    ``cut``: only the rows before it are held against the others; 0: all against all.
    """
    forest = Forest(len(fps))
    forest.label = label
    rows = np.arange(len(fps))
    ranges = parts(64 * fps.shape[1], max_bits)
    for pair in zip(ranges[::2], ranges[1::2]):
        values = [_take(fps, *r) for r in pair]
        both = (values[0] << np.uint64(32)) | values[1]
        for value, (first, last) in zip(values, pair):
            width = min(last - first, _KEY_BITS)
            key = (value >> np.uint64(last - first - width)).astype(np.int64)
            left = _Runs(rows[:cut] if cut else rows, key, forest.label, both, width)
            right = _Runs(rows[cut:], key, forest.label, both, width) if cut else left
            for mask in [sum(1 << b for b in set(bits)) for k in range(_PART_BITS + 1) for bits in itertools.combinations(range(width), k)]:
                for x, y in _candidates(left, right, mask):
                    for at in range(0, len(x), _LEAF_PAIRS):
                        u, v = x[at : at + _LEAF_PAIRS], y[at : at + _LEAF_PAIRS]
                        near = np.bitwise_count(fps[u] ^ fps[v]).sum(axis=1, dtype=np.int64) <= max_bits
                        forest.link(u[near], v[near])
    return forest.label


def _meet(max_bits: int):
    """From the rows (unit, side, root, fp) of pairs of blocks, all of a unit in one task: edges (u, v) between roots that links across components connect."""

    def links(side: np.ndarray, root: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(side, kind="stable")
        root, fps = root[order], fps[order].astype(np.uint64)
        _, first, at = np.unique(root, return_index=True, return_inverse=True)
        label, cut = first[at], int(np.count_nonzero(side == 0))
        if cut < len(side) and (cut or side[order[0]] == 2):  # two blocks, sides 0 and 1, or one with itself, side 2
            label = rest_links(fps, label, max_bits, cut)
        found = first[label[first] != first]
        return pa.RecordBatch.from_arrays([pa.array(root[found], pa.int64()), pa.array(root[label[found]], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, raw = [], []
        for batch in batches:
            columns.append(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("unit", "side", "root")]))
            raw.append(b"".join(batch.column("fp").to_pylist()))
        if not raw:
            return
        unit, side, root = np.concatenate(columns, axis=1)
        fps = np.frombuffer(b"".join(raw), ">u8").reshape(-1, WORDS)
        raw.clear()
        for one in np.unique(unit):
            rows = np.flatnonzero(unit == one)
            yield links(side[rows], root[rows], fps[rows])

    return run


def _rest(placed: DataFrame, n: int, max_bits: int, blocks: int | None = None) -> DataFrame:
    """Edges (u, v) between the components (root) of a written table (node, fp, root) of ``n`` rows that any link connects, whether or not its texts share a bucket."""
    blocks = blocks or min(MOST_BLOCKS, max(1, round(math.sqrt(n / SHARE))))
    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    met = placed.select("root", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    unit = (high * (high + 1) / 2).cast("int") + low
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") == high).cast("int"))
    met = met.select(unit.alias("unit"), side.alias("side"), "root", "fp")
    return met.repartitionById(blocks * (blocks + 1) // 2, F.col("unit")).mapInArrow(_meet(max_bits), "u long, v long").distinct()


def near_groups(docs: DataFrame, *, similarity: float = SIMILARITY, block: int = BLOCK, blocks: int | None = None) -> DataFrame:
    """Groups documents by chains of links: doc_id, component_id, kept and the row's number.

    ``blocks``: how many the second pass makes, by default as many as the number
    of fingerprints asks for; it changes no result.

    Words are runs of anything but ASCII white space, A-Z in lower case; a text
    of fewer than five is one shingle; null, empty and blank texts have a
    fingerprint of zeros and are linked to each other. component_id is the
    smallest doc_id of the group, null if all of them are; ``kept`` is set for its
    row, or the first of several. Rows that repeat are grouped each for itself; an
    empty table gives an empty one; other columns are ignored.
    """
    rows = docs if UID in docs.columns else pick(docs, "doc_id", "text").withColumn(UID, F.monotonically_increasing_id())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", UID)
    sketches = materialise(rows.mapInArrow(_sketch, f"doc_id long, {UID} long, fp binary, met array<long>"), "sketches")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(UID).alias("uid")))
    distinct = materialise(sketches.groupBy("fp").agg(F.count("*").alias("n_rows"), best.alias("best"), F.min(UID).alias("node"), F.min_by("met", UID).alias("met")), "distinct", few=True)
    stars = components(_edges(distinct, budget(similarity), block), "stars")

    def place(stars: DataFrame) -> DataFrame:
        found = distinct.select("node", "fp", "n_rows", "best").join(stars.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("v", "node")).drop("v")
        return materialise(found, "placed", few=True)

    placed = place(stars)
    rest = materialise(_rest(placed, distinct.count(), budget(similarity), blocks), "rest", few=True)
    if not rest.isEmpty():
        merged = components(stars.unionByName(rest), "stars")
        discard(placed, stars)
        stars, placed = merged, place(merged)
    discard(rest)
    roots = materialise(placed.groupBy("root").agg(F.min("best").alias("least"), F.count("*").alias("n_fps")), "roots", few=True)
    groups = materialise(skew_join(placed.select("fp", "n_rows", "root"), roots, ["root"], "n_fps", placed.count(), ["fp"]), "groups", few=True)
    joined = skew_join(sketches.select("doc_id", UID, "fp"), groups.select("fp", "n_rows", "least"), ["fp"], "n_rows", sketches.count(), [UID])
    discard(distinct, stars, placed, roots)
    return joined.select("doc_id", F.col("least.doc_id").alias("component_id"), (F.col(UID) == F.col("least.uid")).alias("kept"), UID)


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of :func:`near_groups`, with all its columns, whatever their names.

    Nulls, blanks, ties, repeats and empty tables: as in :func:`near_groups`.
    """
    return keep_rows(docs, lambda rows: near_groups(rows, **options))
