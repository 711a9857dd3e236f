"""All registered queries of the library."""

from larkspur.plans import catalog, documents, formats, layouts, numbers, shapes, statistics, streams
from larkspur.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "documents", "formats", "layouts", "numbers", "shapes", "statistics", "streams"]
