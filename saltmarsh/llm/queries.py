"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from saltmarsh.llm import alignment, decontam, divergence, fingerprints, language, ngram_join, packing, pii, pitman_yor, quality, suffix_dedup, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": pii.op1,
    "op2_best_fit_packing": packing.op2,
    "op3_pitman_yor_scoring": pitman_yor.op3,
    "op4_benchmark_decontamination": decontam.op4,
    "op5_suffix_array_dedup": suffix_dedup.op5,
    "op6_ngram_jaccard_join": ngram_join.op6,
    "op7_language_id": language.op7,
    "op8_quality_rules": quality.op8,
    "op9_token_counts": tokens.op9,
    "op10_toxicity": toxicity.op10,
    "op11_tokenizer_alignment": alignment.op11,
    "op12_source_divergence": divergence.op12,
    "op13_document_fingerprints": fingerprints.op13,
}

SQL: dict[str, str] = {
    "op4_benchmark_decontamination": decontam.SQL,
    "op12_source_divergence": divergence.SQL,
}
