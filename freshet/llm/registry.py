"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from freshet.llm import html_text, jaccard, media, mixing, ordinal, packing, quality, rans, resampling, secret_scan, sharding, suffixes, whitening

QUERIES = {
    "op1_poisson_mix": mixing.op1_poisson_mix,
    "op2_ordinal_grades": ordinal.op2_ordinal_grades,
    "op3_repetition_rules": quality.op3_repetition_rules,
    "op4_rans_ids": rans.op4_rans_ids,
    "op5_chunked_media": media.op5_chunked_media,
    "op6_rendezvous_shards": sharding.op6_rendezvous_shards,
    "op7_secret_automaton": secret_scan.op7_secret_automaton,
    "op8_vector_packing": packing.op8_vector_packing,
    "op9_partenum_jaccard": jaccard.op9_partenum_jaccard,
    "op10_block_tree": html_text.op10_block_tree,
    "op11_jacobi_davidson": whitening.op11_jacobi_davidson,
    "op12_previous_factors": suffixes.op12_previous_factors,
    "op13_head_tail_resampling": resampling.op13_head_tail_resampling,
}

ORACLE = {"op1_poisson_mix": mixing.OP1_SQL, "op3_repetition_rules": quality.OP3_SQL, "op6_rendezvous_shards": sharding.OP6_SQL, "op9_partenum_jaccard": jaccard.OP9_SQL, "op10_block_tree": html_text.OP10_SQL, "op12_previous_factors": suffixes.OP12_SQL, "op13_head_tail_resampling": resampling.OP13_SQL}
