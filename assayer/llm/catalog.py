"""The queries of this folder and their DuckDB twins."""

from __future__ import annotations

from . import bpe, conversation_repair, decontaminate, exact_repeats, html_text, language_model, license_scan, neighbours, periodic_runs, sharding, simhash, toxicity, url_filter

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_pivot_simhash": simhash.query,
    "op3_simhash_decontamination": decontaminate.query,
    "op4_projected_neighbours": neighbours.query,
    "op5_jump_sharding": sharding.query,
    "op6_pair_index_bpe": bpe.query,
    "op7_naive_bayes_toxicity": toxicity.query,
    "op8_block_rules_html": html_text.query,
    "op9_context_tree_weighting": language_model.query,
    "op10_url_language_ratio": url_filter.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_suffix_array_dedup": exact_repeats.query,
}

ORACLES = {
    "op3_simhash_decontamination": decontaminate.ORACLE_SQL,
    "op5_jump_sharding": sharding.ORACLE_SQL,
    "op10_url_language_ratio": url_filter.ORACLE_SQL,
}
