"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from fieldloom.llm import bpe, exact, html, jaccard, langid, lines, minhash, packing, quality, spelling, suffix, warc, whitening

_MODULES = (bpe, minhash, suffix, exact, packing, lines, html, warc, quality, langid, whitening, jaccard, spelling)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
