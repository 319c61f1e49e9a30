"""The named queries of this subpackage, with their SQL where SQL can express them.

Each query applies one operator, with the parameters given here, to a whole table.
"""

from __future__ import annotations

from sparkloom.llm import corpus_queries, jaccard_queries, store_queries, substring_queries, token_queries, vector_queries

_MODULES = (corpus_queries, jaccard_queries, store_queries, substring_queries, token_queries, vector_queries)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
