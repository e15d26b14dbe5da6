"""Imports every query module, so that the registry is complete."""

from ensspark.plans import change_queries, document_queries, filing_queries, storage_queries, stream_queries, tracker_queries  # noqa: F401
from ensspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
