"""The corpus queries opN_<name> and their oracle SQL."""

from __future__ import annotations

from cloudloom.llm import audit, bpe, chat, ctw, decontaminate, exact, lexical, pii, quality, sharding, simhash, simple8b, unigram


def queries() -> dict:
    """Name to function of (spark, sf_dir)."""
    return {
        "op1_chat_perspectives": chat.op1_chat_perspectives,
        "op2_simple8b_ids": simple8b.op2_simple8b_ids,
        "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_pii_spans": pii.op5_pii_spans,
        "op6_unigram_token_counts": unigram.op6_unigram_token_counts,
        "op7_extendible_shards": sharding.op7_extendible_shards,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_context_tree_scores": ctw.op9_context_tree_scores,
        "op10_byte_bpe": bpe.op10_byte_bpe,
        "op11_filter_audit": audit.op11_filter_audit,
        "op12_exact_dedup": exact.op12_exact_dedup,
        "op13_lexical_search": lexical.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by the same names; operators that SQL can't express have none."""
    return {
        "op1_chat_perspectives": chat.SQL,
        "op7_extendible_shards": sharding.SQL,
        "op11_filter_audit": audit.SQL,
        "op12_exact_dedup": exact.SQL,
        "op13_lexical_search": lexical.SQL,
    }
