"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import collocation, fingerprint, htmltext, langid, mixing, negatives, neardup, packing, quality, secretscan, sharding, substring, tokenstore

QUERIES = {
    "op1_html_extraction": htmltext.query,
    "op2_minhash_near_dedup": neardup.query,
    "op3_quality_rules": quality.query,
    "op4_best_fit_packing": packing.query,
    "op5_source_mixing": mixing.query,
    "op6_sharding": sharding.query,
    "op7_language_id": langid.query,
    "op8_substring_dedup": substring.query,
    "op9_token_output": tokenstore.query,
    "op10_document_fingerprints": fingerprint.query,
    "op11_secret_scans": secretscan.query,
    "op12_hard_negatives": negatives.query,
    "op13_phrase_collocations": collocation.query,
}

ORACLE = {
    "op2_minhash_near_dedup": neardup.ORACLE,
    "op3_quality_rules": quality.ORACLE,
    "op8_substring_dedup": substring.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
    "op13_phrase_collocations": collocation.ORACLE,
}
