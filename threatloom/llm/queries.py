"""The corpus operators' queries and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from threatloom.llm import divergence, jaccard, lines, lmscore, media, mixing, negatives, packing, quality, suffix, tokens, urlfilter, warc


def queries() -> dict:
    return {
        "op1_warc_revisits": warc.op1_warc_revisits,
        "op2_url_filters": urlfilter.op2_url_filters,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_suffix_array_dedup": suffix.op4_suffix_array_dedup,
        "op5_ngram_jaccard_join": jaccard.op5_ngram_jaccard_join,
        "op6_line_dedup": lines.op6_line_dedup,
        "op7_lm_scoring": lmscore.op7_lm_scoring,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_mixing": mixing.op9_mixing,
        "op10_media_columns": media.op10_media_columns,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_token_counts": tokens.op13_token_counts,
    }


def oracle_sql() -> dict:
    return {
        "op1_warc_revisits": warc.OP1_SQL,
        "op2_url_filters": urlfilter.OP2_SQL,
        "op5_ngram_jaccard_join": jaccard.OP5_SQL,
        "op6_line_dedup": lines.OP6_SQL,
        "op7_lm_scoring": lmscore.OP7_SQL,
        "op9_mixing": mixing.OP9_SQL,
        "op11_hard_negatives": negatives.OP11_SQL,
        "op12_source_divergence": divergence.OP12_SQL,
    }
