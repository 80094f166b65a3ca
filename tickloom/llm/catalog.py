"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import chunk_dedup, hmm_lm, merkle, mixing, packing, quality_rules, resampling, simhash, site_quality, suffix_dedup, token_files, vector_search, warc

MODULES = (suffix_dedup, token_files, hmm_lm, simhash, packing, mixing, site_quality, chunk_dedup, vector_search, quality_rules, warc, merkle, resampling)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
