"""Training-data operators. Nothing else in the library imports this subpackage."""

from . import bpe, chat, jaccard, langid, lm, merkle, packing, pq, quality, shard, simhash, urlfilter, wordpiece

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_language_id": langid.op2,
    "op3_sharding": shard.op3,
    "op4_byte_bpe": bpe.op4,
    "op5_url_filters": urlfilter.op5,
    "op6_simhash": simhash.op6,
    "op7_best_fit_packing": packing.op7,
    "op8_token_counts": wordpiece.op8,
    "op9_jaccard_join": jaccard.op9,
    "op10_lm_scoring": lm.op10,
    "op11_vector_codes": pq.op11,
    "op12_chat_formatting": chat.op12,
    "op13_merkle_manifest": merkle.op13,
}

ORACLE_SQL = {"op1_quality_rules": quality.SQL, "op5_url_filters": urlfilter.SQL, "op11_vector_codes": pq.SQL, "op12_chat_formatting": chat.SQL, "op13_merkle_manifest": merkle.SQL}
