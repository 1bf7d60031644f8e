"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from quillmill.llm import bpe, decontaminate, html, language, periods, quality, secrets, sharding, simhash, substrings, vector_codes, warc, wordpiece

MODULES = [quality, html, bpe, secrets, decontaminate, wordpiece, sharding, language, simhash, substrings, warc, vector_codes, periods]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
