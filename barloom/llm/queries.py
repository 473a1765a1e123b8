"""The queries of this subpackage and their SQL, for the driver's entry file."""

from __future__ import annotations

from . import bpe, embedding_dedup, exact_dedup, importance, jaccard_join, mixing, packing, secrets, suffix_dedup, token_counts, token_files, toxicity, vector_codes

QUERIES = {
    "op1_mixing_sources_to_target_weights": mixing.op1_query,
    "op2_embedding_near_dedup": embedding_dedup.op2_query,
    "op3_suffix_array_dedup": suffix_dedup.op3_query,
    "op4_token_counts": token_counts.op4_query,
    "op5_best_fit_packing": packing.op5_query,
    "op6_exact_dedup": exact_dedup.op6_query,
    "op7_toxicity": toxicity.op7_query,
    "op8_ngram_jaccard_join": jaccard_join.op8_query,
    "op9_token_id_files": token_files.op9_query,
    "op10_secret_scans": secrets.op10_query,
    "op11_target_distribution_importance_resampling": importance.op11_query,
    "op12_vector_code_compression": vector_codes.op12_query,
    "op13_bpe_encoding_and_decoding": bpe.op13_query,
}

#: The others' results (drawn rates, library tokens, fitted models, byte spans, automata) are beyond SQL: tests hold them against brute force.
SQL = {
    "op2_embedding_near_dedup": embedding_dedup.OP2_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op8_ngram_jaccard_join": jaccard_join.OP8_SQL,
    "op11_target_distribution_importance_resampling": importance.OP11_SQL,
    "op12_vector_code_compression": vector_codes.OP12_SQL,
}
