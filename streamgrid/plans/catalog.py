"""All registered queries."""

from __future__ import annotations

from streamgrid.plans import align_queries, grid_queries, metric_queries, source_queries, split_queries, stream_queries
from streamgrid.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "align_queries", "grid_queries", "metric_queries", "source_queries",
           "split_queries", "stream_queries"]
