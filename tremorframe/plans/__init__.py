"""Named queries over the driver's tables."""

from . import catalog_queries, entity_queries, kernel_queries, signal_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
