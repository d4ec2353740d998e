"""Operators of a training-data pipeline; nothing else in the library imports this package."""

from harvestline.llm import (bpe_verify, conversation_repair, embedding_dedup, packing, pieces_fst, quality_cnn, sharding, simhash,
                             sketch, suffix_dedup, token_files, url_filter, whitening)

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_token_files": token_files.query,
    "op3_extendible_shards": sharding.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_quality_cnn": quality_cnn.query,
    "op6_best_fit_packing": packing.query,
    "op7_embedding_near_dedup": embedding_dedup.query,
    "op8_simhash_near_dedup": simhash.query,
    "op9_scaled_sketch": sketch.query,
    "op10_pieces_fst": pieces_fst.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_spectrum_whitening": whitening.query,
    "op13_bpe_verify": bpe_verify.query,
}

SQL = {"op1_url_filter": url_filter.SQL, "op3_extendible_shards": sharding.SQL,
       "op7_embedding_near_dedup": embedding_dedup.SQL}
