"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from brieflake.plans import retrieval_queries, source_queries, vote_queries

_ALL = retrieval_queries.QUERIES | vote_queries.QUERIES | source_queries.QUERIES

QUERIES = {name: fn for name, (fn, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
