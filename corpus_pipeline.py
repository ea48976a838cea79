"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its decisions take
effect on what the next one gets. All but the last return the columns of
``documents``, whatever further ones there are and whatever they are called.

In every stage a null text counts as empty, rows with a null doc_id are rows like
any other, and an empty table gives an empty one. Ties are settled by doc_id and
then by a row's place, so of rows that repeat wholly exactly one can stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frametide.llm._common import discard, materialise, table
from frametide.llm.best_fit_packing import best_fit_packing
from frametide.llm.exact_dedup import drop_exact_copies
from frametide.llm.near_copies import drop_near_copies
from frametide.llm.quality_rules import drop_low_quality
from frametide.llm.toxicity import drop_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents whose ledger has a bit of the current policy's mask go. Blank texts have too few words and go; repeats are judged alike."""
    return drop_low_quality(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents whose expected severity reaches the model's cut go; it is trained on those of ``docs`` that ``labels`` covers. Without toxic and clean ones among these all stay; repeats are judged alike."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: one row of each group of texts that are equal but for ASCII white space stays, that of most code points, then of smallest doc_id."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of texts linked by their fingerprints of 5-word shingles, which differ in no more bits than a similarity of 0.8 gives, the row of smallest doc_id stays."""
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all that is left, one row a piece with its token ids (little-endian, four bytes each)."""
    return best_fit_packing(docs, keep_ids=True, cache_chunks=100_000)


STAGES = [("quality", quality), ("toxicity", toxic), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("packing", packing)]

#: A trained model and tokenised packing can't be expressed in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next; what a stage was given goes once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        left = materialise(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = left
    return STAGES[-1][1](spark, docs, sf_dir)
