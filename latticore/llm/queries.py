"""The registered queries of this subpackage, and their SQL where it can express them."""

from latticore.llm import bpe_fst, chat, filter_audit, hmm_lm, language_id, mixing, page_diff, parity_join, quality, substring_dedup, token_links, topk, url_trie

QUERIES = {
    "op1_page_text": page_diff.op1_page_text,
    "op2_hmm_scores": hmm_lm.op2_hmm_scores,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_url_filter": url_trie.op4_url_filter,
    "op5_bpe": bpe_fst.op5_bpe,
    "op6_jaccard_join": parity_join.op6_jaccard_join,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_top_k": topk.op8_top_k,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_perspectives": chat.op10_perspectives,
    "op11_token_links": token_links.op11_token_links,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_language_id": language_id.op13_language_id,
}

ORACLES = {
    "op1_page_text": page_diff.OP1_SQL,
    "op4_url_filter": url_trie.OP4_SQL,
    "op7_substring_dedup": substring_dedup.OP7_SQL,
    "op8_top_k": topk.OP8_SQL,
    "op10_perspectives": chat.OP10_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}
