"""Registry of this subpackage's queries and their oracle SQL."""

from __future__ import annotations

from siftwright.llm import mixing, packing, pii, quality, repair, resample, secret_scan, shards, simhash, toxicity, urls, vectors, warc

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_semi_markov_pii": pii.op2_semi_markov_pii,
    "op3_min_bin_slack": packing.op3_min_bin_slack,
    "op4_kd_shards": shards.op4_kd_shards,
    "op5_url_filter": urls.op5_url_filter,
    "op6_cover_tree_dedup": vectors.op6_cover_tree_dedup,
    "op7_warc_index": warc.op7_warc_index,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_importance_resample": resample.op12_importance_resample,
    "op13_toxicity": toxicity.op13_toxicity,
}
SQL = {
    "op5_url_filter": urls.SQL,
    "op6_cover_tree_dedup": vectors.SQL,
    "op9_quality_rules": quality.SQL,
}
