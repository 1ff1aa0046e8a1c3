"""Queries of the engine over the standard tables, with their SQL twins."""

from vexel.plans import engine_queries, search_queries, store_queries
from vexel.plans.base import ORACLES, QUERIES

flagship = search_queries.knn_batch_cosine

__all__ = ["ORACLES", "QUERIES", "engine_queries", "flagship", "store_queries"]
