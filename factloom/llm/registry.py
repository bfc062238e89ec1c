"""Queries and SQL of the training-data operators, by registered name."""

from __future__ import annotations

from . import chat_format, collocations, context_mixing, decontaminate, line_dedup, mixing, pq_neighbours, quality, rp_forest, suffix_dedup, token_counts, trie_join, tsqr

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op5_context_mixing": context_mixing.op5_context_mixing,
    "op3_pq_neighbours": pq_neighbours.op3_pq_neighbours,
    "op2_chat_format": chat_format.op2_chat_format,
    "op4_mixing": mixing.op4_mixing,
    "op6_trie_join": trie_join.op6_trie_join,
    "op6_join_links": trie_join.op6_join_links,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_quality": quality.op9_quality,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_rp_forest": rp_forest.op11_rp_forest,
    "op12_tsqr_whitening": tsqr.op12_tsqr_whitening,
    "op13_collocations": collocations.op13_collocations,
}
ORACLE = {
    "op4_mixing": mixing.ORACLE,
    "op6_trie_join": trie_join.ORACLE,
    "op6_join_links": trie_join.LINKS_ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
