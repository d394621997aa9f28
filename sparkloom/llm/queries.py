"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from sparkloom.llm import divergence_audit, exact_dedup, fingerprints, language_id, license_scan, mixing, order_minhash, pieces, pipeline, quality_crf, quality_rules, token_alignment, token_codes, toxicity


def queries() -> dict:
    return {
        "op1_licenses": license_scan.op1_licenses,
        "op2_quality": quality_crf.op2_quality,
        "op3_fingerprints": fingerprints.op3_fingerprints,
        "op4_rules": quality_rules.op4_rules,
        "op5_tokens": token_codes.op5_tokens,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_language": language_id.op7_language,
        "op8_mix": mixing.op8_mix,
        "op9_pieces": pieces.op9_pieces,
        "op10_order_minhash": order_minhash.op10_order_minhash,
        "op11_alignment": token_alignment.op11_alignment,
        "op12_exact_dedup": exact_dedup.op12_exact_dedup,
        "op13_source_audit": divergence_audit.op13_source_audit,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op1_licenses": license_scan.OP1_SQL, "op4_rules": quality_rules.OP4_SQL, "op8_mix": mixing.OP8_SQL, "op12_exact_dedup": exact_dedup.OP12_SQL, "op13_source_audit": divergence_audit.OP13_SQL}
