"""Queries of this subpackage, one an operator, and their SQL where SQL can express them."""

from __future__ import annotations

from scanloom.llm import (
    centroids,
    decontamination,
    fingerprints,
    importance,
    jaccard_join,
    language,
    line_dedup,
    lm_scores,
    mixing,
    pii,
    quality,
    sharding,
    token_counts,
)

MODULES = (mixing, lm_scores, decontamination, token_counts, quality, language, fingerprints, pii, jaccard_join, sharding, line_dedup, importance, centroids)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE", {}).items()}
