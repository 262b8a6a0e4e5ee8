"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, html_extract, language_id, packing, pii, search, sentencepieces, sharding, simhash, token_output

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_pii": pii.op2_pii,
    "op3_feistel_sharding": sharding.op3_feistel_sharding,
    "op4_kk_packing": packing.op4_kk_packing,
    "op5_html_extraction": html_extract.op5_html_extraction,
    "op6_sentencepiece": sentencepieces.op6_sentencepiece,
    "op7_bm25_topk": search.op7_bm25_topk,
    "op8_token_output": token_output.op8_token_output,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_language_id": language_id.op10_language_id,
}

ORACLE_SQL = {
    "op9_exact_dedup": exact_dedup.OP9_SQL,
}
