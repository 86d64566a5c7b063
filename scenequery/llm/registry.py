"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, divergence, hard_negatives, language, licences, line_dedup, lm_scoring, near_dedup, neighbours, sentencepieces
from .mixing import op2_mixing
from .packing import op3_packing
from .quality import op8_quality_rules

QUERIES = {
    "op1_license_scan": licences.op1_license_scan,
    "op2_mixing": op2_mixing,
    "op3_packing": op3_packing,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_chat_format": chat.op5_chat_format,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_lm_scoring": lm_scoring.op7_lm_scoring,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": language.op9_language_id,
    "op10_nearest": neighbours.op10_nearest,
    "op11_sentencepiece": sentencepieces.op11_sentencepiece,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_source_divergence": divergence.op13_source_divergence,
}
ORACLE_SQL = {
    "op1_license_scan": licences.oracle_sql(),
    "op4_line_dedup": line_dedup.oracle_sql(),
    "op5_chat_format": chat.oracle_sql(),
    "op12_hard_negatives": hard_negatives.oracle_sql(),
    "op13_source_divergence": divergence.oracle_sql(),
}
