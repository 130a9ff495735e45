"""Named queries: one per operator, each over the driver's tables."""

from . import (  # noqa: F401
    case_queries,
    clean_queries,
    graph_queries,
    lookup_queries,
    mart_queries,
    rule_queries,
    source_queries,
    stream_queries,
    text_queries,
    travel_queries,
    triple_queries,
    vector_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
