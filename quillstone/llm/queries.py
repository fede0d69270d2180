"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import compression_quality, exact_topk, hash_forest, language_id, line_dedup, mixing, ngram_join, packing, token_matrix, toxic_segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_ngram_jaccard": ngram_join.op3_ngram_jaccard,
    "op4_compression_quality": compression_quality.op4_compression_quality,
    "op5_hash_prefix_forest": hash_forest.op5_hash_prefix_forest,
    "op6_language_id": language_id.op6_language_id,
    "op7_token_matrix": token_matrix.op7_token_matrix,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_toxic_segments": toxic_segments.op9_toxic_segments,
    "op10_exact_topk": exact_topk.op10_exact_topk,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_source_mixing": mixing.ORACLE,
    "op3_ngram_jaccard": ngram_join.ORACLE,
    "op10_exact_topk": exact_topk.ORACLE,
}
