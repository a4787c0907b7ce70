"""Registered queries over the given tables, with the SQL they must agree with."""

from feedforge.workload import (  # noqa: F401
    candidate_queries,
    log_queries,
    metric_queries,
    model_queries,
    sample_queries,
    stream_queries,
    user_queries,
    vector_queries,
)
from feedforge.workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
