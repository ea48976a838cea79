"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from frametide.llm import chat_format, exact_dedup, license_scan, quality_rules
from frametide.llm.best_fit_packing import op9_best_fit_packing
from frametide.llm.bpe_codec import op3_bpe_codec
from frametide.llm.chat_format import op4_chat_format
from frametide.llm.exact_dedup import op1_exact_dedup
from frametide.llm.license_scan import op7_license_scan
from frametide.llm.quality_rules import op8_quality_rules
from frametide.llm.sharding import op10_sharding
from frametide.llm.simhash_dedup import op6_simhash_dedup
from frametide.llm.token_count import op2_token_counts
from frametide.llm.toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_chat_format": op4_chat_format,
    "op5_toxicity": op5_toxicity,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_chat_format": chat_format.SQL,
    "op7_license_scan": license_scan.sql(),
    "op8_quality_rules": quality_rules.SQL,
}
