"""The queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from quillstone.llm import bpe, centroids, decontaminate, fingerprints, language, language_model, near_dedup, packing, shards, token_counts, toxicity, warc, whitening

_MODULES = (decontaminate, toxicity, language_model, shards, bpe, token_counts, warc, fingerprints, language, near_dedup, packing, whitening, centroids)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
