"""The queries of this subpackage."""

from __future__ import annotations

from foliant.llm import chunks, decontaminate, langid, lines, packing, pii, quality, records, simhash, toxicity

_MODULES = (decontaminate, chunks, simhash, langid, lines, records, pii, toxicity, quality, packing)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
