"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from . import bpe, embedding_dedup, jaccard_join, packing, prefix_trie, quality_classifier, quality_rules, sharding, source_divergence, suffix_dedup, token_counts, url_filter, warc


def queries() -> dict:
    return {
        "op1_quality_classifier": quality_classifier.op1_quality_classifier,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_sharding": sharding.op3_sharding,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_bpe": bpe.op6_bpe,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_warc": warc.op10_warc,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_source_divergence": source_divergence.op12_source_divergence,
        "op13_token_counts": token_counts.op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {k: v for module in (suffix_dedup, quality_rules, url_filter, embedding_dedup, jaccard_join, warc, prefix_trie, source_divergence) for k, v in module.ORACLE_SQL.items()}
