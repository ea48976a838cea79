"""Quality rules as a ledger of bit masks.

Every rule is evaluated once a document. The ledger keeps its measurements and
one long whose bit i says that rule i failed. Policies are sets of rules, that
is, masks with a version: a document passes one if no bit of the mask is set.
Changing a policy or asking what a rule does on its own reads the ledger only,
by bitwise operations, and never the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from frametide.llm._common import pick, table

WINDOW = 5
#: Windows of longer texts are numbered, not kept as bytes.
LONG_TEXT = 20_000
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + _UPPER.lower()
_NOT_UPPER = bytes(set(range(256)) - set(_UPPER))
_NOT_LETTERS = bytes(set(range(256)) - set(_LETTERS))
_NOT_SYMBOLS = bytes(set(range(256)) - set(_SYMBOLS))

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper"]

#: Rule -> failed if. A rule's bit is its place here; new rules go at the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 and 10 * n_dup_lines > 4 * n_lines",
    "shouting": "n_letters >= 50 and 10 * n_upper > 7 * n_letters",
}

#: Versioned policies. "base" is what every later one includes.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "long_words", "symbols", "duplicate_lines"),
    "v2": ("few_words", "repeated_windows", "short_words", "long_words", "symbols", "duplicate_lines", "shouting"),
}
POLICY = "v2"


def mask(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _repeated_in_long(words: list[bytes], width: int) -> int:
    """:func:`repeated_words` by numbers: each word's, then each window's, built up pair by pair, so memory stays a few longs a word."""
    numbers: dict[bytes, int] = {}
    window = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    single, size = window, 1
    while size < width:
        step = min(size, width - size)
        right = window[size:] if step == size else single[size:]
        step = step if step == size else 1
        left = window[: len(right)]
        window = np.unique(left * (int(right.max()) + 1) + right[: len(left)], return_inverse=True)[1]
        size += step
    at = np.flatnonzero(np.bincount(window)[window] > 1)
    edges = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + width, minlength=len(words) + 1)
    return int((np.cumsum(edges) > 0).sum())


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a ``width``-word window found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if n > LONG_TEXT:
        return _repeated_in_long(words, width)
    joined = b" ".join(words)
    starts, ends, at = [], [], 0
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    windows = [joined[a:b] for a, b in zip(starts, ends[width - 1 :])]
    if len(set(windows)) == n:
        return 0
    seen: set[bytes] = set()
    twice: set[bytes] = set()
    for x in windows:
        (twice if x in seen else seen).add(x)
    covered, reach = 0, 0
    for i, x in enumerate(windows):
        if x in twice:
            covered += i + width - max(i, reach)
            reach = i + width
    return covered


def measure(text: str) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one text."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else [raw] if words else []
    word_bytes = b"".join(words)
    word_chars = len(word_bytes) if word_bytes.isascii() else len(word_bytes.decode())
    symbols, letters, upper = (len(raw.translate(None, other)) for other in (_NOT_SYMBOLS, _NOT_LETTERS, _NOT_UPPER))
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), letters, upper


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t.as_py() or "") for t in batch.column("text")]
        columns = zip(*rows) if rows else [[] for _ in MEASURES]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failed``: bit i is set if rule i of ``RULES`` failed.

    Words are runs of anything but ASCII white space, letters are ASCII ones. A null text has no words,
    which fails "few_words"; rows with a null or repeated doc_id get a row each;
    an empty table gives an empty one; other columns are ignored.
    """
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    measured = docs.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    return measured.withColumn("failed", failed_bits())


def failed_bits() -> Column:
    """The long of failed rules, from the measurements."""
    bits = F.lit(0).cast("long")
    for i, failed in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def passes(policy: str, failed: Column | str = "failed") -> Column:
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(book: DataFrame, policy: str = POLICY) -> DataFrame:
    """What each rule of a policy does: rule, n_failed, n_only (documents that this rule alone rejects), n_kept_without (kept if the rule went)."""
    whole = mask(POLICIES[policy])
    in_policy = F.col("failed").bitwiseAND(F.lit(whole).cast("long"))
    names = list(RULES)
    sums = []
    for r in POLICIES[policy]:
        bit = 1 << names.index(r)
        sums += [
            F.count_if(in_policy.bitwiseAND(F.lit(bit).cast("long")) != 0).alias(f"{r}_failed"),
            F.count_if(in_policy == bit).alias(f"{r}_only"),
            F.count_if(in_policy.bitwiseAND(F.lit(whole & ~bit).cast("long")) == 0).alias(f"{r}_without"),
        ]
    one = book.agg(*sums)
    rows = [F.struct(F.lit(r).alias("rule"), F.col(f"{r}_failed").alias("n_failed"), F.col(f"{r}_only").alias("n_only"), F.col(f"{r}_without").alias("n_kept_without")) for r in POLICIES[policy]]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def quality_rules(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    return ledger(docs).withColumns({"base_failed": ~passes("base"), "kept": passes("base") & passes(policy)})


def drop_low_quality(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The rows of ``docs`` that pass a policy by the ledger's mask, with all their columns, whatever their names, in one pass without a shuffle.

    A null, empty or blank text has no words and goes; each row is judged for
    itself, repeats alike; an empty table gives an empty one.
    """
    cols = docs.columns
    text_at = cols.index("text")
    plain = docs.toDF(*[f"_c{i}" for i in range(len(cols))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py() or "") for t in batch.column(text_at)]
            columns = zip(*rows) if rows else [[] for _ in MEASURES]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], names=[*batch.schema.names, *MEASURES])

    measured = plain.mapInArrow(run, StructType([*plain.schema.fields, *(StructField(m, LongType()) for m in MEASURES)]))
    book = measured.withColumn("failed", failed_bits())
    return book.filter(passes("base") & passes(policy)).select(*plain.columns).toDF(*cols)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), l AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), w AS (
  SELECT doc_id, text, words, lines,
         list_transform(range(1, greatest(len(words) - 3, 1)), lambda i: array_to_string(words[i:i + 4], ' ')) AS windows
  FROM l
), c AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n
  FROM (SELECT doc_id, unnest(windows) AS x, unnest(range(len(windows))) AS i FROM w)
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM c, range(5) AS t(k) WHERE n > 1 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 5 * n_symbols > n_words OR (n_lines >= 4 AND 10 * n_dup_lines > 4 * n_lines)
            OR (n_letters >= 50 AND 10 * n_upper > 7 * n_letters)) AS kept,
       n_lines, n_letters, n_upper,
       CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
            + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 8 ELSE 0 END
            + CASE WHEN 5 * n_symbols > n_words THEN 16 ELSE 0 END + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 4 * n_lines THEN 32 ELSE 0 END
            + CASE WHEN n_letters >= 50 AND 10 * n_upper > 7 * n_letters THEN 64 ELSE 0 END AS BIGINT) AS failed
FROM m
"""
