"""All queries of the core, by name, and the SQL that states the same."""

from unitquarry.plans import search_queries, snapshot_queries, source_queries, store_queries

FLAGSHIP = "rerank"
MODULES = [search_queries, store_queries, source_queries, snapshot_queries]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
