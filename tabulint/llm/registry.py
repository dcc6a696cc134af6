"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from tabulint.llm import q_tables

QUERIES = dict(q_tables.QUERIES)
ORACLES = dict(q_tables.ORACLES)
