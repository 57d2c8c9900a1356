"""All queries outside the optional subpackage for training text."""

from __future__ import annotations

from palimpsest.plans import evaluation_queries, history_queries, ingest_queries, read_queries, source_queries, stream_queries, write_queries

_MODULES = [history_queries, ingest_queries, write_queries, read_queries, evaluation_queries, source_queries, stream_queries]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
FLAGSHIP = "recall_score"
