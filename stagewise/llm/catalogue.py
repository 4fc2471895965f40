"""Registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from stagewise.llm import collocations, conversation_trie, decontamination, jaccard_join, oracles, packing, privacy, quality_rules, sharding, substring_dedup, suffix_dedup, token_counts, token_files, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        suffix_dedup.op1_suffix_dedup,
        token_counts.op2_token_counts,
        quality_rules.op3_quality_rules,
        packing.op4_packing,
        privacy.op5_private_data,
        substring_dedup.op6_substring_dedup,
        jaccard_join.op7_jaccard_join,
        decontamination.op8_decontamination,
        toxicity.op9_toxicity,
        sharding.op10_sharding,
        collocations.op11_collocations,
        token_files.op12_token_files,
        conversation_trie.op13_conversation_trie,
    )
}
SQL = {
    "op6_substring_dedup": oracles.SUBSTRINGS.strip(),
    "op7_jaccard_join": oracles.NEAR_COPIES.strip(),
    "op8_decontamination": oracles.CONTAINED.strip(),
    "op11_collocations": oracles.PHRASES.strip(),
    "op13_conversation_trie": oracles.TRIE.strip(),
}
