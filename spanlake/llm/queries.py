"""The operators' registered queries and, where SQL can express them on whole tables, their oracles."""

from __future__ import annotations

from . import chat, ctw, decontaminate, langid, mixing, sharding, simhash, spotsigs, toxicity, warc

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
    "op2_context_tree_weighting": ctw.op2_context_tree_weighting,
    "op3_preference_format": chat.op3_preference_format,
    "op4_language_id": langid.op4_language_id,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_warc_round_trip": warc.op8_warc_round_trip,
    "op9_shard_documents": sharding.op9_shard_documents,
    "op10_spot_signatures": spotsigs.op10_spot_signatures,
}

ORACLES = {
    "op1_benchmark_decontamination": decontaminate.OP1_SQL,
    "op3_preference_format": chat.OP3_SQL,
    "op8_warc_round_trip": warc.OP8_SQL,
}
