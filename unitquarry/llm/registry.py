"""All queries on training data, by name, and the SQL that states the same."""

from unitquarry.llm import handwritten, neardup, neighbours, packing, personal, splitting, tokens

MODULES = [splitting, neardup, neighbours, handwritten, tokens, packing, personal]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
