"""All core queries and their SQL."""

from __future__ import annotations

from marketloom.plans import data_queries, listing_queries, reference_queries, replay_queries, rule_queries

MODULES = (data_queries, reference_queries, listing_queries, rule_queries, replay_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
