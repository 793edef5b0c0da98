"""Queries and oracle SQL of this subpackage, for the driver's entry module."""

from auralake.llm import decontaminate, divergence, exact_dups, infill, language, near_dups, pseudonyms, quality, repeats, source_mix, token_counts, top_k, toxicity

_MODULES = (pseudonyms, token_counts, decontaminate, toxicity, repeats, source_mix, quality, near_dups, language, top_k, exact_dups, infill, divergence)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
