"""The registered ``opN_<name>`` queries and their DuckDB statements."""

from __future__ import annotations

from lithoframe.llm import decontaminate, fingerprints, golden_records, html_text, language_model, languages, licenses, near_dedup, packing, quality, ranked_search, suffix_dedup, token_counts


def queries():
    return {
        "op1_benchmark_leaks": decontaminate.op1_benchmark_leaks,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_best_two_fit": packing.op3_best_two_fit,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_main_text": html_text.op5_main_text,
        "op6_simhash_fingerprints": fingerprints.op6_simhash_fingerprints,
        "op7_gru_scores": language_model.op7_gru_scores,
        "op8_simhash_groups": near_dedup.op8_simhash_groups,
        "op9_byte_cnn_quality": quality.op9_byte_cnn_quality,
        "op10_prefix_free_dedup": suffix_dedup.op10_prefix_free_dedup,
        "op11_block_max_search": ranked_search.op11_block_max_search,
        "op12_language_mixtures": languages.op12_language_mixtures,
        "op13_golden_records": golden_records.op13_golden_records,
    }


def oracle_sql():
    return {"op11_block_max_search": ranked_search.OP11_SQL, "op13_golden_records": golden_records.OP13_SQL}
