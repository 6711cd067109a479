"""All registered queries of the conflation engine."""

from __future__ import annotations

from plotlink.plans import apply_queries, footprint_queries, graph_queries, matching_queries, overlay_queries, session_queries, text_queries

_MODULES = (matching_queries, text_queries, graph_queries, footprint_queries, session_queries, apply_queries, overlay_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
