"""The queries of this package, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from . import html_extract, language_id, mixing, ngram_join, packing, quality_classifier, quality_rules, sharding, substring, topk


def queries() -> dict:
    return {
        "op1_mixing": mixing.query,
        "op2_ngram_join": ngram_join.query,
        "op3_topk_search": topk.query,
        "op4_packing": packing.query,
        "op5_substring_dedup": substring.query,
        "op6_sharding": sharding.query,
        "op7_quality_classifier": quality_classifier.query,
        "op8_quality_rules": quality_rules.query,
        "op9_language_id": language_id.query,
        "op10_html_extraction": html_extract.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.ORACLE, "op2_ngram_join": ngram_join.ORACLE, "op3_topk_search": topk.ORACLE, "op8_quality_rules": quality_rules.ORACLE}
