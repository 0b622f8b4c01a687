"""Named queries over the driver's tables and the SQL that must give the same rows."""

from __future__ import annotations

from trellica.plans import align_queries, format_queries, layered_queries, report_queries, seed_queries

QUERIES = {**align_queries.QUERIES, **seed_queries.QUERIES, **layered_queries.QUERIES, **report_queries.QUERIES, **format_queries.QUERIES}
ORACLES = {**align_queries.ORACLES, **seed_queries.ORACLES, **layered_queries.ORACLES, **report_queries.ORACLES, **format_queries.ORACLES}
FLAGSHIP = "flagship"
