"""Toxicity as an ordinal severity, by cumulative-link regression on sparse text features.

A document's grade is 0 (clean) to ``GRADES - 1``. The model has one weight a
feature, shared by all thresholds, and ordered thresholds between the grades:
P(grade <= k) = sigmoid(theta_k - w . x). Its output is the expected grade.

Features are whole words, their beginnings, and, of runs of letters too long to
be one word or in a script without spaces, every gram of a few letters. They are
weighted by the logarithm of their share in the text, so that a long text isn't
toxic for its length. The features kept are those whose use differs most between
toxic and clean labelled documents; there are at most ``FEATURES``.

Labels only say toxic or not, so the grades above 0 are derived, not observed: a
toxic document's grade is its density of the strongest cues, by thirds. Those
cues are found in one half of the sample and graded in the other, so that no
document's grade comes from its own words' statistics.

The model is fitted on a bounded sample, at most ``TRAIN_ROWS`` labelled
documents, drawn by a hash of doc_id from those that the table holds. It then
grades every document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.llm._common import filter_arrow, materialise, pick, table
from frametide.llm._words import chunks

GRADES = 4
TRAIN_ROWS = 12_000
FEATURES = 4_096
MIN_DOCS = 4
BEGINNINGS = (3, 4, 5, 6, 7)
STEPS = 400
L2 = 2e-4
CACHE_CHUNKS = 200_000

_WORD = regex.compile(r"\p{L}+")
#: Scripts that are written without spaces: a run of letters may be a sentence.
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
#: Longer runs of letters give grams too, and stand as features by their hash.
LONG_WORD = 24
GRAMS, UNSPACED_GRAMS = (5,), (1, 2, 3)


def features_of_chunk(chunk: str) -> list[str]:
    """The features of a run of non-space characters: its words in lower case ("w:"), their beginnings ("b:") and, of long or unspaced ones, all their grams ("g:")."""
    out = []
    for word in _WORD.findall(chunk.lower()):
        unspaced = not word.isascii() and _UNSPACED.search(word) is not None
        out.append(f"w:{word}" if len(word) <= LONG_WORD else f"w#{xxhash.xxh64_hexdigest(word.encode())}")
        out.extend(f"b:{word[:n]}" for n in BEGINNINGS if len(word) > n)
        for n in UNSPACED_GRAMS if unspaced else GRAMS if len(word) > LONG_WORD else ():
            out.extend(f"g:{word[i : i + n]}" for i in range(len(word) - n + 1))
    return out


@dataclass
class Model:
    """``index``: feature -> number; ``weights``; ``thetas``: GRADES - 1 ordered thresholds; ``cut``: expected grade from which a document is toxic."""

    index: dict[str, int]
    weights: np.ndarray
    thetas: np.ndarray
    cut: float


class _Chunks(dict):
    """Chunk -> numbers of its known features."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        get = self.index.get
        got = tuple(i for f in features_of_chunk(chunk) if (i := get(f)) is not None)
        if len(chunk) <= 48:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = got
        return got


def vector(text: str, known: _Chunks) -> tuple[list[int], list[float], int]:
    """A text's features, their values, and its number of white-space-separated words."""
    words = chunks(text)
    counts: Counter[int] = Counter()
    for got in filter(None, map(known.__getitem__, words)):
        counts.update(got)
    n = max(1, len(words))
    return list(counts), [math.log1p(200 * c / n) for c in counts.values()], len(words)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def expected_grade(score: np.ndarray | float, thetas: np.ndarray) -> np.ndarray:
    """The sum over k of P(grade > k)."""
    return _sigmoid(np.asarray(score)[..., None] - thetas).sum(axis=-1)


def loss_and_gradient(params: np.ndarray, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, l2: float) -> tuple[float, np.ndarray]:
    """The mean negative log-likelihood of the grades with its penalty, and its gradient by weights, first threshold and logarithms of gaps."""
    n, w, raw = len(grades), params[:n_features], params[n_features:]
    gaps = np.exp(raw[1:])
    thetas = np.concatenate([raw[:1], raw[0] + np.cumsum(gaps)])
    score = np.bincount(rows, values * w[cols], n)
    edges = np.concatenate([[-np.inf], thetas, [np.inf]])
    hi, lo = _sigmoid(edges[grades + 1] - score), _sigmoid(edges[grades] - score)
    p = np.maximum(hi - lo, 1e-12)
    d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
    grad = np.zeros_like(params)
    grad[:n_features] = np.bincount(cols, values * (d_hi - d_lo)[rows], n_features) / n + l2 * w
    by_theta = np.array([(d_lo[grades == k + 1]).sum() - (d_hi[grades == k]).sum() for k in range(len(raw))]) / n
    tails = np.cumsum(by_theta[::-1])[::-1]
    grad[n_features] = tails[0]
    grad[n_features + 1 :] = tails[1:] * gaps
    return float(-np.log(p).mean() + l2 / 2 * (w @ w)), grad


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int = GRADES, steps: int = STEPS, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam over all rows.

    Thresholds are the first and the logarithms of the gaps after it, which keeps
    them in order.
    """
    params = np.zeros(n_features + n_grades - 1)
    params[n_features] = 2.0
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        _, grad = loss_and_gradient(params, rows, cols, values, grades, n_features, l2)
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        params -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    raw = params[n_features:]
    return params[:n_features], np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])


def best_cut(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The expected grade from which calling a document toxic gives the best F1, midway to the next lower one."""
    order = np.argsort(-severity)
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + toxic.sum())
    at = int(np.argmax(f1))
    low = severity[order[at + 1]] if at + 1 < len(order) else 0.0
    return float((severity[order[at]] + low) / 2)


def derived_grades(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, toxic: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """0 for clean documents; for toxic ones 1 to ``GRADES - 1`` by thirds of their density of cues, which are found in the other half of the documents."""
    half = np.arange(len(toxic)) % 2
    density = np.zeros(len(toxic))
    for h in (0, 1):
        held, n_toxic = half == h, int(toxic[half == h].sum())
        n_clean = int(held.sum()) - n_toxic
        a = np.bincount(cols[(held & (toxic == 1))[rows]], minlength=len(usable))
        d = np.bincount(cols[held[rows]], minlength=len(usable))
        pull = np.log((a + 0.5) / (n_toxic - a + 0.5)) - np.log((d - a + 0.5) / (n_clean - d + a + 0.5))
        cue = usable & (pull > 2) & (d >= MIN_DOCS // 2)
        density += np.where(half != h, np.bincount(rows, values * cue[cols], len(toxic)), 0.0)
    marks = np.quantile(density[toxic == 1], [k / (GRADES - 1) for k in range(1, GRADES - 1)])
    return np.where(toxic == 1, 1 + np.searchsorted(marks, density, "right"), 0)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` rows, one a doc_id: doc_id, toxic, text."""
    marked = pick(labels, "doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    plain = pick(docs, "doc_id", "text")
    found = marked.join(plain.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = found.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(rows)  # the documented bound
    of_id = plain.join(F.broadcast(chosen), "doc_id").groupBy("doc_id")
    return of_id.agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, features: int = FEATURES) -> Model | None:
    """Fits the model on at most ``rows`` labelled documents; None if the sample lacks toxic or clean ones.

    Rows of ``labels`` without doc_id or toxic, and those whose document isn't in
    ``docs``, are left out before the bound; a document labelled more than once
    counts as toxic if any of its labels says so. A doc_id that repeats in
    ``docs`` counts once, with the text of the smallest hash.
    """
    sample = materialise(labelled_sample(docs, labels, rows), "labelled", few=True)

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents and toxic documents that use each feature, added up before they leave the task."""
        seen: Counter[str] = Counter()
        toxic_: Counter[str] = Counter()

        def batch_of() -> pa.RecordBatch:
            names = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic_[f] for f in names], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["f", "a", "d"])

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                own = {f for c in set(chunks(text.as_py() or "")) for f in features_of_chunk(c)}
                seen.update(own)
                if toxic:
                    toxic_.update(own)
                if len(seen) > 200_000:
                    yield batch_of()
                    seen.clear()
                    toxic_.clear()
        yield batch_of()

    totals = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, n_toxic = totals["n"], totals["toxic"] or 0
    if not 0 < n_toxic < n:
        return None
    counts = sample.mapInArrow(used, "f string, a long, d long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("d").alias("d"))
    odds = lambda hit, all_: F.log((hit + 0.5) / (F.lit(all_) - hit + 0.5))
    pull = odds(F.col("a"), n_toxic) - odds(F.col("d") - F.col("a"), n - n_toxic)
    strength = F.abs(pull) * F.sqrt(F.least(F.col("d"), F.lit(50)))
    best = counts.filter(F.col("d") >= MIN_DOCS).withColumn("pull", pull).orderBy(strength.desc(), "f").limit(features).collect()  # at most ``features`` rows
    if not best:
        return None
    index = {r["f"]: i for i, r in enumerate(best)}
    whole = np.array([r["f"][0] != "b" for r in best])
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Chunks(shared.value)
        for batch in batches:
            got = [vector(t.as_py() or "", known) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float64()))],
                names=["doc_id", "toxic", "i", "v"],
            )

    got = sorted(sample.mapInArrow(vectors, "doc_id long, toxic int, i array<int>, v array<double>").collect(), key=lambda r: r["doc_id"])  # at most ``rows`` rows of at most ``features`` numbers
    toxic = np.array([r["toxic"] for r in got])
    rows_ = np.repeat(np.arange(len(got)), [len(r["i"]) for r in got])
    cols = np.concatenate([np.array(r["i"], np.int64) for r in got])
    values = np.concatenate([np.array(r["v"]) for r in got])
    grades = derived_grades(rows_, cols, values, toxic, whole)
    weights, thetas = fit_ordinal(rows_, cols, values, grades, len(index))
    severity = expected_grade(np.bincount(rows_, values * weights[cols], len(got)), thetas)
    return Model(index, weights, thetas, best_cut(severity, toxic))


def grade(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, severity (expected grade), grade (nearest), is_toxic, kept, for every row; without a model none is toxic."""
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(_grader(docs.sparkSession, model, "doc_id", None), "doc_id long, severity double, grade int, is_toxic boolean, kept boolean")


def _grader(spark: SparkSession, model: Model | None, id_col: str | None, keep_at: int | None):
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = _Chunks(m.index) if m else None
        weights = m.weights.tolist() if m else []
        for batch in batches:
            texts = batch.column(keep_at) if keep_at is not None else batch.column("text")
            scores = []
            for text in texts if m else []:
                i, v, _ = vector(text.as_py() or "", known)
                scores.append(sum(weights[a] * b for a, b in zip(i, v)))
            severity = expected_grade(np.array(scores), m.thetas) if m else np.zeros(batch.num_rows)
            toxic = severity >= m.cut if m else np.zeros(batch.num_rows, bool)
            if keep_at is not None:
                yield batch.filter(pa.array(~toxic))
                continue
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(severity), pa.array(np.rint(severity).astype(np.int32)), pa.array(toxic), pa.array(~toxic)],
                names=["doc_id", "severity", "grade", "is_toxic", "kept"],
            )

    return run


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Trains on the labelled documents and grades all.

    A null or empty text has no features: its severity is the model's base rate,
    and it isn't toxic unless every text is. Rows with a null or repeated doc_id
    are graded each for itself; an empty table, or one without labelled toxic
    and clean documents, is all clean; other columns are ignored. Texts are read
    whole, whatever their length or script.
    """
    return grade(docs, train(docs, labels, **options))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns, whatever their names; the model is trained on those of them that are labelled.

    Each row is judged for itself, repeats alike. Rows without text stay, and so
    does every row where ``labels`` has no toxic or no clean document of ``docs``.
    An empty table gives an empty one.
    """
    model = train(docs, labels, **options)
    return filter_arrow(docs, _grader(docs.sparkSession, model, None, docs.columns.index("text")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
