"""Name of each query of this subpackage to its callable and to its oracle."""

from __future__ import annotations

import corpus_pipeline
from glosswork.llm import align, bpe, chat, decontaminate, license_scan, line_rules, negatives, personal, quality, sharding, simhash, substring, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1,
        "op2_quality": quality.op2,
        "op3_line_rules": line_rules.op3,
        "op4_decontaminate": decontaminate.op4,
        "op5_substring_dedup": substring.op5,
        "op6_license_scan": license_scan.op6,
        "op7_sharding": sharding.op7,
        "op8_chat_format": chat.op8,
        "op9_byte_bpe": bpe.op9,
        "op10_simhash_near_dedup": simhash.op10,
        "op11_hard_negatives": negatives.op11,
        "op12_personal_data": personal.op12,
        "op13_token_alignment": align.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op3_line_rules": line_rules.OP3_SQL,
        "op8_chat_format": chat.OP8_SQL,
        "op11_hard_negatives": negatives.OP11_SQL,
    }
