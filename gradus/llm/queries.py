"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from gradus.llm import bpe, dialogue_repair, exact_dedup, language_id, merkle, mixing, pii, rlz_dedup, simhash, suffix_dedup, topk_search, url_filter, vector_dedup

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_mixing": mixing.op2_mixing,
    "op3_pii": pii.op3_pii,
    "op4_simhash": simhash.op4_simhash,
    "op5_bpe": bpe.op5_bpe,
    "op6_rlz_dedup": rlz_dedup.op6_rlz_dedup,
    "op7_topk_search": topk_search.op7_topk_search,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_merkle": merkle.op11_merkle,
    "op12_dialogue_repair": dialogue_repair.op12_dialogue_repair,
    "op13_vector_dedup": vector_dedup.op13_vector_dedup,
}

ORACLES = {
    "op6_rlz_dedup": rlz_dedup.ORACLE,
    "op9_suffix_dedup": suffix_dedup.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op7_topk_search": topk_search.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op12_dialogue_repair": dialogue_repair.ORACLE,
    "op13_vector_dedup": vector_dedup.ORACLE,
}
