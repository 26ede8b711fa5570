"""The queries of this subpackage, for the entry module."""

from __future__ import annotations

from . import bpe, chat, divergence, exact, interplay, packing, pii, quality, rules, secrets, simhash, suffix_dedup, toxicity

MODULES = (packing, pii, exact, toxicity, secrets, rules, bpe, suffix_dedup, quality, simhash, divergence, chat, interplay)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
