"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from reelgrid.llm import bpe, hard_negatives, language, line_dedup, near_dup, near_vectors, packing, quality, quality_rules, recurrent_lm, suffixes, telephony, whitening

MODULES = [telephony, language, near_dup, recurrent_lm, quality_rules, bpe, quality, suffixes, line_dedup, packing, whitening, hard_negatives, near_vectors]


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
