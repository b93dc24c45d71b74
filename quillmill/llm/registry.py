"""The queries of this package and their SQL."""

from __future__ import annotations

from . import byte_bpe, decontaminate, line_dedup, lm_scoring, packing, preferences, pseudonyms, quality, secrets, simhash, spelling, substring_dedup, transactions

QUERIES = {
    "op1_preferences": preferences.op1_preferences,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    "op11_byte_bpe": byte_bpe.op11_byte_bpe,
    "op12_transactions": transactions.op12_transactions,
    "op13_spelling": spelling.op13_spelling,
    "op2_packing": packing.op2_packing,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_quality": quality.op6_quality,
    "op7_secrets": secrets.op7_secrets,
    "op8_pseudonyms": pseudonyms.op8_pseudonyms,
    "op9_decontaminate": decontaminate.op9_decontaminate,
}

ORACLES = preferences.ORACLE | line_dedup.ORACLE | quality.ORACLE
