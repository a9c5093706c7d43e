"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from quillon.llm import chat_format, decontaminate, exact_dedup, language_id, line_dedup, packing, pii, quality, simhash, substring_dedup

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_packing": packing.query,
    "op3_pii": pii.query,
    "op4_decontamination": decontaminate.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_quality": quality.query,
    "op7_chat_format": chat_format.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_simhash": simhash.query,
    "op10_language_id": language_id.query,
}
ORACLES = {"op1_line_dedup": line_dedup.ORACLE, "op4_decontamination": decontaminate.ORACLE, "op7_chat_format": chat_format.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE}
