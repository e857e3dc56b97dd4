"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from palimpsest.llm import bpe, exact_dedup, line_dedup, mixing, near_dedup, secrets, substring_dedup, topk, toxicity, warc

MODULES = (toxicity, mixing, substring_dedup, bpe, line_dedup, secrets, near_dedup, topk, exact_dedup, warc)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
