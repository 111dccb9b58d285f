"""Queries of the numbered operators and of the pipeline, with their DuckDB SQL."""

from __future__ import annotations

from netvigil.llm import (chat_format, decontaminate, jaccard_join, license_scan, lm_scoring, packing, periodic_runs,
                         quality_classifier, quality_rules, token_counts, token_store, url_filters, whitening)


def llm_queries():
    """Query per operator."""
    return {
        "op1_quality_classifier": quality_classifier.op1_quality_classifier,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_chat_formatting": chat_format.op4_chat_formatting,
        "op5_url_filters": url_filters.op5_url_filters,
        "op6_lm_scoring": lm_scoring.op6_lm_scoring,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_ngram_jaccard_join": jaccard_join.op9_ngram_jaccard_join,
        "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_token_id_output": token_store.op12_token_id_output,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    }


def llm_oracles():
    """DuckDB SQL of the queries that SQL can express."""
    return {
        "op4_chat_formatting": chat_format.ORACLE,
        "op5_url_filters": url_filters.ORACLE,
    }
