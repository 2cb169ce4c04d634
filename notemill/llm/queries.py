"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, licenses, masked_lm, quality_rules, secrets, simhash, suffix_dedup, url_filters

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_chat": chat.op2_chat,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_bpe": bpe.op4_bpe,
    "op5_url_filters": url_filters.op5_url_filters,
    "op6_licenses": licenses.op6_licenses,
    "op7_simhash": simhash.op7_simhash,
    "op8_masked_lm": masked_lm.op8_masked_lm,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_secrets": secrets.op10_secrets,
}

ORACLE_SQL: dict[str, str] = {"op2_chat": chat.ORACLE, "op3_decontaminate": decontaminate.ORACLE, "op5_url_filters": url_filters.ORACLE}
