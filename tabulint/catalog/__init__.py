"""The registered queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from tabulint.catalog import findings, graphs, joins, reports, texts

QUERIES, ORACLES = {}, {}
for part in (texts, joins, findings, graphs, reports):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
