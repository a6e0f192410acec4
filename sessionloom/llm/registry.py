"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from sessionloom.llm import bpe, centroids, media, mixing, packing, ppm, quality_rules, simhash, spelling, suffix_dedup, toxicity, training_order, url_filter


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.query,
        "op2_ppm_scoring": ppm.query,
        "op3_url_filter": url_filter.query,
        "op4_suffix_dedup": suffix_dedup.query,
        "op5_source_mixing": mixing.query,
        "op6_training_order": training_order.query,
        "op7_media_columns": media.query,
        "op8_simhash": simhash.query,
        "op9_byte_bpe": bpe.query,
        "op10_toxicity": toxicity.query,
        "op11_centroids": centroids.query,
        "op12_spelling": spelling.query,
        "op13_packing": packing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.ORACLE, "op5_source_mixing": mixing.ORACLE, "op11_centroids": centroids.ORACLE, "op12_spelling": spelling.ORACLE}
