"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm import exact_dup, fill_middle, html_text, language, merkle, mixing, near_dup, packing, private_data, quality, suffix_tree, token_count, token_output

QUERIES = {
    "op1_minhash_near_dedup": near_dup.op1_minhash_near_dedup,
    "op2_pack_token_ids": token_output.op2_pack_token_ids,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_html_main_text": html_text.op4_html_main_text,
    "op5_compression_language_id": language.op5_compression_language_id,
    "op6_pack_in_order": packing.op6_pack_in_order,
    "op7_contextual_private_data": private_data.op7_contextual_private_data,
    "op8_golomb_exact_dedup": exact_dup.op8_golomb_exact_dedup,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_token_counts": token_count.op10_token_counts,
    "op11_fill_in_middle": fill_middle.op11_fill_in_middle,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_suffix_tree_scores": suffix_tree.op13_suffix_tree_scores,
}
SQL = {
    "op1_minhash_near_dedup": near_dup.SQL,
    "op3_mix_sources": mixing.SQL,
    "op8_golomb_exact_dedup": exact_dup.SQL,
    "op9_quality_rules": quality.SQL,
    "op11_fill_in_middle": fill_middle.SQL,
    "op12_merkle_manifest": merkle.SQL,
}
