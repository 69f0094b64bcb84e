"""Queries of this subpackage and the SQL that gives the same rows, by name."""

from __future__ import annotations

from groundtrace.llm import decontamination, language, line_dedup, media, mixing, near_dedup, preferences, secrets, token_counts, toxicity

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_language": language.op3_language,
    "op4_mixing": mixing.op4_mixing,
    "op5_secrets": secrets.op5_secrets,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_media": media.op7_media,
    "op8_preferences": preferences.op8_preferences,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_token_counts": token_counts.op10_token_counts,
}

ORACLE_SQL = {
    "op1_decontamination": decontamination.OP1_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op8_preferences": preferences.OP8_SQL,
}
