"""Queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm import ann, html_text, line_dedup, media, merkle, mixing, ngram_join, packing, pieces, secrets, surrogates, toxicity, turns


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op2_mix_sources": mixing.op2_mix_sources,
        "op4_media_columns": media.op4_media_columns,
        "op9_html_text": html_text.op9_html_text,
        "op10_ngram_jaccard": ngram_join.op10_ngram_jaccard,
        "op11_repair_conversations": turns.op11_repair_conversations,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_pack_sequences": packing.op13_pack_sequences,
        "op1_toxicity": toxicity.op1_toxicity,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_nearest_vectors": ann.op6_nearest_vectors,
        "op3_fuzzy_lines": line_dedup.op3_fuzzy_lines,
        "op7_sentencepiece": pieces.op7_sentencepiece,
        "op8_pii_surrogates": surrogates.op8_pii_surrogates,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix_sources": mixing.SQL,
        "op10_ngram_jaccard": ngram_join.SQL,
        "op11_repair_conversations": turns.SQL,
        "op12_merkle_manifest": merkle.SQL,
    }
