"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rostercast.llm import block_labeller, conversation_repair, fit_packing, merkle_manifest, minhash_dedup, pfor_files, prefix_decontamination, pu_quality, random_secrets, range_dedup, ring_shards, sampled_pieces, tree_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sampled_pieces": sampled_pieces.op1_sampled_pieces,
    "op2_fit_packing": fit_packing.op2_fit_packing,
    "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
    "op4_block_labeller": block_labeller.op4_block_labeller,
    "op5_random_secrets": random_secrets.op5_random_secrets,
    "op6_ring_shards": ring_shards.op6_ring_shards,
    "op7_tree_search": tree_search.op7_tree_search,
    "op8_pfor_token_files": pfor_files.op8_pfor_token_files,
    "op9_range_dedup": range_dedup.op9_range_dedup,
    "op10_pu_quality": pu_quality.op10_pu_quality,
    "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
    "op12_prefix_decontamination": prefix_decontamination.op12_prefix_decontamination,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLE: dict[str, str] = {
    "op3_minhash_dedup": minhash_dedup.SQL,
    "op9_range_dedup": range_dedup.SQL,
    "op11_merkle_manifest": merkle_manifest.SQL,
    "op12_prefix_decontamination": prefix_decontamination.SQL,
    "op13_conversation_repair": conversation_repair.SQL,
}
