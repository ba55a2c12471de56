"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import clustering, decontaminate, exact_dedup, html_extract, language_id, near_dedup, packing, prefix_trie, quality_model, quality_rules, secret_scan, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_dart_minhash": near_dedup.op1_dart_minhash,
    "op2_tag_paths": html_extract.op2_tag_paths,
    "op3_best_two_fit": packing.op3_best_two_fit,
    "op4_prefix_join": decontaminate.op4_prefix_join,
    "op5_cross_parsing": language_id.op5_cross_parsing,
    "op6_divergence": quality_rules.op6_divergence,
    "op7_compression_novelty": secret_scan.op7_compression_novelty,
    "op8_virtual_slots": sharding.op8_virtual_slots,
    "op9_boosted_toxicity": toxicity.op9_boosted_toxicity,
    "op10_fourier_quality": quality_model.op10_fourier_quality,
    "op11_content_sort": exact_dedup.op11_content_sort,
    "op12_drake_bounds": clustering.op12_drake_bounds,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op4_prefix_join": decontaminate.OP4_SQL,
    "op11_content_sort": exact_dedup.OP11_SQL,
    "op12_drake_bounds": clustering.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
