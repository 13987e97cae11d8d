"""All core queries and their SQL counterparts, by name."""

from __future__ import annotations

from notegraph.plans import graph, notes, references, search, streams

_PARTS = (graph, notes, search, streams, references)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
