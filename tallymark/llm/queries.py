"""The numbered operators as registered queries, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import bpe, jaccard_join, language_id, license_scan, merkle, packing, quality_qda, quality_rules
from tallymark.llm import prefix_trie, ring_shards, toxicity, vector_codes, warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_license_scan": license_scan.license_scan_query,
    "op2_quality_qda": quality_qda.quality_query,
    "op3_language_id": language_id.language_query,
    "op4_bpe": bpe.bpe_query,
    "op5_quality_rules": quality_rules.quality_rules,
    "op6_packing": packing.packing_query,
    "op7_merkle": merkle.merkle_query,
    "op8_toxicity": toxicity.toxicity_query,
    "op9_jaccard_join": jaccard_join.jaccard_query,
    "op10_ring_shards": ring_shards.ring_shards_query,
    "op11_warc_salvage": warc.warc_query,
    "op12_vector_codes": vector_codes.vector_codes_query,
    "op13_prefix_trie": prefix_trie.prefix_trie_query,
}

ORACLE: dict[str, str] = {
    "op1_license_scan": license_scan.ORACLE_SQL,
    "op5_quality_rules": quality_rules.ORACLE_SQL,
    "op7_merkle": merkle.ORACLE_SQL,
    "op9_jaccard_join": jaccard_join.ORACLE_SQL,
    "op11_warc_salvage": warc.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
