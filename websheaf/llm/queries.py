"""The subpackage's registered queries, and SQL where it can express them."""

from __future__ import annotations

from websheaf.llm import bpe, chat_format, exact_dedup, fill_in_middle, html_extract, language_id, lexical_search, minhash, mixing, simhash, token_store, topk_search, toxicity

QUERIES = {
    "op1_topk_search": topk_search.op1_topk_search,
    "op2_html_extraction": html_extract.op2_html_extraction,
    "op3_token_store": token_store.op3_token_store,
    "op4_language_id": language_id.op4_language_id,
    "op5_simhash_near_dedup": simhash.op5_simhash,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_bpe": bpe.op8_bpe,
    "op9_source_mixing": mixing.op9_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_minhash_near_dedup": minhash.op13_minhash_near_dedup,
}

SQL = {"op1_topk_search": topk_search.OP1_SQL, "op6_chat_format": chat_format.OP6_SQL, "op7_exact_dedup": exact_dedup.OP7_SQL, "op9_source_mixing": mixing.OP9_SQL, "op11_fill_in_middle": fill_in_middle.OP11_SQL, "op12_lexical_search": lexical_search.OP12_SQL}
