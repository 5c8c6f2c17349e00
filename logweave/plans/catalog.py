"""All queries of the engine: name -> (query, SQL or None)."""

from __future__ import annotations

from . import cache_queries, file_queries, further_queries, log_queries, service_queries, state_queries, telemetry_queries

CATALOG = {}
for module in (state_queries, service_queries, cache_queries, telemetry_queries, log_queries, further_queries, file_queries):
    CATALOG |= module.CATALOG
