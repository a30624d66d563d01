"""Registered queries of the text operators and their SQL counterparts."""

from __future__ import annotations

import corpus_pipeline

from . import byte_bpe, exact_dedup, language_id, license_scan, lm_score, near_dedup, packing, periodic_runs, prefix_trie, quality, revisits, simhash_dedup, topk_search


def queries():
    return {
        "op1_exact_dedup": exact_dedup.op1,
        "op2_quality": quality.op2,
        "op3_topk_search": topk_search.op3,
        "op4_near_dedup": near_dedup.op4,
        "op5_revisits": revisits.op5,
        "op6_packing": packing.op6,
        "op7_license_scan": license_scan.op7,
        "op8_lm_score": lm_score.op8,
        "op9_language_id": language_id.op9,
        "op10_byte_bpe": byte_bpe.op10,
        "op11_simhash_dedup": simhash_dedup.op11,
        "op12_periodic_runs": periodic_runs.op12,
        "op13_prefix_trie": prefix_trie.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op1_exact_dedup": exact_dedup.ORACLE_SQL,
        "op3_topk_search": topk_search.ORACLE_SQL,
        "op5_revisits": revisits.ORACLE_SQL,
        "op13_prefix_trie": prefix_trie.ORACLE_SQL,
    }
