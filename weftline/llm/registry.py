"""Queries of the operators of this subpackage, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, jaccard_join, lang_ecoc, lp_packing, media_archive, morton_layout, prefix_trie, quality_ledger, repair_store, secret_markov, source_mix, token_rollup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_ledger": quality_ledger.op1,
    "op2_secret_markov": secret_markov.op2,
    "op3_bpe_codec": bpe_codec.op3,
    "op4_media_archive": media_archive.op4,
    "op5_lang_ecoc": lang_ecoc.op5,
    "op6_repair_store": repair_store.op6,
    "op7_toxicity": toxicity.op7,
    "op8_lp_packing": lp_packing.op8,
    "op9_token_rollup": token_rollup.op9,
    "op10_jaccard_join": jaccard_join.op10,
    "op11_prefix_trie": prefix_trie.op11,
    "op12_morton_layout": morton_layout.op12,
    "op13_source_mix": source_mix.op13,
    "quality_ablations": quality_ledger.quality_ablations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_ledger": quality_ledger.SQL,
    "op10_jaccard_join": jaccard_join.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_morton_layout": morton_layout.SQL,
    "op13_source_mix": source_mix.SQL,
    "quality_ablations": quality_ledger.ABLATIONS_SQL,
}
