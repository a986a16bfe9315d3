"""All queries of the core by name, with the SQL that gives the same rows."""

from __future__ import annotations

from sentria.plans import queries as Q
from sentria.plans.oracle import ORACLE_SQL

NAMES = (
    "normalize_ws split_sentences sentence_spans stream_split word_tokens sentence_len_stats lexical_density punct_rates contractions tell_words mattr bigram_repetition trigram_repetition local_bigram_overlap style_features "
    "dedup_docs seeded_sample exclude_polished_sources union_corpora reconstruct_docs chunk_ranges midpoint_labels sentence_dataset group_split split_counts docs_per_bucket job_cross round_robin subset_per_group polish_merge clean_text paragraph_chunks "
    "lm_token_stats token_to_sentence sentence_signals doc_perplexity nll_ratio feature_matrix scaler_fit class_weights linear_score contributions top_reasons doc_summary confusion roc_auc cohort_bias confident_wrong "
    "history_topk valid_texts text_preview html_escape prob_color all_features result_json logreg_fit gbt_fit "
    "saved_model_score fitted_scores bias_gap evaluation_report windowed_scores word_bounds style_per_document filled_templates generated_essays row_errors single_split stream_window_counts"
).split()

QUERIES = {name: getattr(Q, name) for name in NAMES}

__all__ = ["ORACLE_SQL", "QUERIES"]
