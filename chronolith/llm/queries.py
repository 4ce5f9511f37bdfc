"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import byte_bpe, chat_format, decontaminate, language_id, minhash_dedup, quality_rules, secret_scan, substring_dedup, toxicity, url_filters


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op10_secret_scan": secret_scan.op10_secret_scan,
        "op2_chat_format": chat_format.op2_chat_format,
        "op3_language_id": language_id.op3_language_id,
        "op4_minhash_dedup": minhash_dedup.op4_minhash_dedup,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_byte_bpe": byte_bpe.op7_byte_bpe,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_url_filters": url_filters.op9_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat_format.OP2_SQL, "op5_substring_dedup": substring_dedup.OP5_SQL, "op9_url_filters": url_filters.OP9_SQL}
