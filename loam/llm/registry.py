"""Queries of this subpackage and their SQL."""
from __future__ import annotations

from . import apportion, block_max_search, feature_dictionary, mil_toxicity, minhash_forest, ngram_bloom, norm_buckets, orc_tokens, pitman_yor, quality_boost, rule_forest, secret_ownership, tree_bpe

MODULES = [ngram_bloom, mil_toxicity, orc_tokens, minhash_forest, secret_ownership, pitman_yor, rule_forest, tree_bpe, apportion, norm_buckets, quality_boost, feature_dictionary, block_max_search]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
