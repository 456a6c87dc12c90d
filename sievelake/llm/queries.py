"""Registered queries of the ten corpus operators and the pipeline, and their SQL."""

from __future__ import annotations

from . import (
    byte_bpe,
    chat_format,
    decontaminate,
    exact_dedup,
    golay_simhash,
    language_id,
    sentence_spans,
    site_tree,
    token_count,
    toxicity,
)


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_query,
        "op2_site_tree": site_tree.op2_query,
        "op3_sentence_spans": sentence_spans.op3_query,
        "op4_chat_format": chat_format.op4_query,
        "op5_byte_bpe": byte_bpe.op5_query,
        "op6_exact_dedup": exact_dedup.op6_query,
        "op7_toxicity": toxicity.op7_query,
        "op8_token_count": token_count.op8_query,
        "op9_golay_simhash": golay_simhash.op9_query,
        "op10_language_id": language_id.op10_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": chat_format.OP4_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL}
