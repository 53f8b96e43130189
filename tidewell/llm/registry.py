"""The operators' queries and SQL."""

from __future__ import annotations

from functools import wraps

from . import (
    decontamination,
    filter_audit,
    license_scan,
    lm_scoring,
    merkle,
    mixing,
    ngram_join,
    pii,
    quality_classifier,
    quality_rules,
    sharding,
    token_output,
    topk_search,
)
from .common import ship


def _sent(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = {
        "op1_quality_classifier": quality_classifier.op1,
        "op2_lm_scoring": lm_scoring.op2,
        "op3_mixing": mixing.op3,
        "op4_sharding": sharding.op4,
        "op5_ngram_join": ngram_join.op5,
        "op6_decontamination": decontamination.op6,
        "op7_pii": pii.op7,
        "op8_license_scan": license_scan.op8,
        "op9_quality_rules": quality_rules.op9,
        "op10_token_output": token_output.op10,
        "op11_topk_search": topk_search.op11,
        "op12_merkle_manifest": merkle.op12,
        "op13_filter_audit": filter_audit.op13,
    }
    return {k: _sent(f) for k, f in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": mixing.OP3_SQL,
        "op6_decontamination": decontamination.OP6_SQL,
        "op8_license_scan": license_scan.OP8_SQL,
        "op11_topk_search": topk_search.OP11_SQL,
        "op12_merkle_manifest": merkle.OP12_SQL,
        "op13_filter_audit": filter_audit.OP13_SQL,
    }
