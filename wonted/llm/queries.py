"""The operators' queries and their SQL counterparts."""

from __future__ import annotations

from wonted.llm import ann, conversation_repair, exact_topk, hard_negatives, language, line_dedup, main_text, mixing, near_dup, packing, quality, sharding, substring_dedup

QUERIES = {
    "op1_bin_slack_packing": packing.query,
    "op2_factorisation_quality": quality.query,
    "op3_dimension_scan_ann": ann.query,
    "op4_byte_shards": sharding.query,
    "op5_line_dedup": line_dedup.query,
    "op6_suffix_array_dedup": substring_dedup.query,
    "op7_impact_topk": exact_topk.query,
    "op8_pivotal_mix": mixing.query,
    "op9_setsketch_near_dup": near_dup.query,
    "op10_evidence_language": language.query,
    "op11_suffix_automaton_repair": conversation_repair.query,
    "op12_secondary_sort_negatives": hard_negatives.query,
    "op13_line_block_text": main_text.query,
}

ORACLES = {
    "op4_byte_shards": sharding.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op7_impact_topk": exact_topk.ORACLE,
    "op11_suffix_automaton_repair": conversation_repair.ORACLE,
    "op12_secondary_sort_negatives": hard_negatives.ORACLE,
}
