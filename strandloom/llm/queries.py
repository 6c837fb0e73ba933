"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from strandloom.llm import bpe, divergence, langid, lexical, media, minhash, mixing, pii, quality_rules, secret_scan, sharding, substring_dedup, suffix_dedup

QUERIES = {
    "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op5_language_id": langid.op5_language_id,
    "op6_pii_surrogates": pii.op6_pii_surrogates,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_media_columns": media.op8_media_columns,
    "op4_hilbert_sharding": sharding.op4_hilbert_sharding,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_mixing": mixing.op10_mixing,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_substring_dedup": substring_dedup.op12_substring_dedup,
    "op13_divergence_audit": divergence.op13_divergence_audit,
}

ORACLES = {
    "op9_quality_rules": quality_rules.ORACLE,
    "op11_lexical_search": lexical.ORACLE,
    "op12_substring_dedup": substring_dedup.ORACLE,
    "op13_divergence_audit": divergence.ORACLE,
}
