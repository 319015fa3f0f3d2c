"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import balltree, content, mixing, ngram_join, packing, permutation, pii, quality, repeats, wordpiece

QUERIES = {
    "op1_top_k": balltree.op1_top_k,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_extract_html": content.op3_extract_html,
    "op4_nearest": permutation.op4_nearest,
    "op5_repeats": repeats.op5_repeats,
    "op6_quality": quality.op6_quality,
    "op10_pii": pii.op10_pii,
    "op7_pack": packing.op7_pack,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_token_counts": wordpiece.op9_token_counts,
}

ORACLE_SQL = {"op1_top_k": balltree.OP1_SQL, "op2_ngram_join": ngram_join.OP2_SQL, "op8_mix_sources": mixing.OP8_SQL}
