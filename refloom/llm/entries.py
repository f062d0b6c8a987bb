"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from refloom.llm import (
    ann,
    chat,
    divergence,
    line_dedup,
    lloyd,
    mixing,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    repeats,
    simhash,
    toxicity,
)


def queries() -> dict:
    return {
        "op1_chat_format": chat.query,
        "op2_quality_classifier": quality_classifier.query,
        "op3_best_fit_packing": packing.query,
        "op4_ngram_jaccard": ngram_join.query,
        "op5_hash_prefix_forest": ann.query,
        "op6_mixing": mixing.query,
        "op7_quality_rules": quality_rules.query,
        "op8_line_dedup": line_dedup.query,
        "op9_suffix_dedup": repeats.query,
        "op10_toxicity": toxicity.query,
        "op11_source_divergence": divergence.query,
        "op12_simhash": simhash.query,
        "op13_centroid_clustering": lloyd.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_mixing": mixing.ORACLE,
        "op7_quality_rules": quality_rules.ORACLE,
        "op8_line_dedup": line_dedup.ORACLE,
        "op11_source_divergence": divergence.ORACLE,
        "op13_centroid_clustering": lloyd.ORACLE,
    }
