"""Operators for large-scale training-data pipelines; nothing else in the library imports this subpackage."""

from __future__ import annotations

from . import chat, decontaminate, divergence, exact_dedup, hard_negatives, line_dedup, ngram_jaccard, packing, pii, quality, secrets, toxicity, urls


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_pii": pii.op2_pii,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_chat_format": chat.op4_chat_format,
        "op5_ngram_jaccard": ngram_jaccard.op5_ngram_jaccard,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_packing": packing.op7_packing,
        "op8_quality": quality.op8_quality,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_secrets": secrets.op10_secrets,
        "op11_url_filter": urls.op11_url_filter,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_source_divergence": divergence.op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op4_chat_format": chat.OP4_SQL,
        "op5_ngram_jaccard": ngram_jaccard.OP5_SQL,
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op11_url_filter": urls.OP11_SQL,
        "op12_hard_negatives": hard_negatives.OP12_SQL,
        "op13_source_divergence": divergence.OP13_SQL,
    }
