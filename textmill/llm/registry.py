"""Queries of this subpackage and the SQL that DuckDB can hold against them."""

from __future__ import annotations

from textmill.llm import decontaminate, lang_id, lm_scoring, packing, quality_rules, secrets, simhash, substrings, tokens, url_filter

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_url_filters": url_filter.query,
    "op3_simhash_near_dedup": simhash.query,
    "op4_token_ids": tokens.query,
    "op5_benchmark_decontamination": decontaminate.query,
    "op6_language_id": lang_id.query,
    "op7_substring_dedup": substrings.query,
    "op8_quality_rules": quality_rules.query,
    "op9_lm_scoring": lm_scoring.query,
    "op10_secret_scans": secrets.query,
}

ORACLE_SQL: dict[str, str] = {"op7_substring_dedup": substrings.SQL}
