"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from foliant.llm import bpe, chat, interactions, kd_tree, language_id, packing, permutation_index, prefix_trie, quality, sharding, simhash, suffix_dedup, warc

QUERIES = {
    "op1_quality_cascade": quality.op1_quality_cascade,
    "op2_simhash_vp_trees": simhash.op2_simhash_vp_trees,
    "op3_preference_pairs": chat.op3_preference_pairs,
    "op4_warc_index": warc.op4_warc_index,
    "op5_language_id": language_id.op5_language_id,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_permutation_index": permutation_index.op9_permutation_index,
    "op10_balanced_shards": sharding.op10_balanced_shards,
    "op11_kd_tree_search": kd_tree.op11_kd_tree_search,
    "op12_filter_interactions": interactions.op12_filter_interactions,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op1_quality_cascade": quality.OP1_SQL,
    "op3_preference_pairs": chat.OP3_SQL,
    "op4_warc_index": warc.OP4_SQL,
    "op11_kd_tree_search": kd_tree.OP11_SQL,
    "op12_filter_interactions": interactions.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
