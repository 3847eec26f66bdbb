"""The named queries, by subject."""

from gaugeline.catalog import checks, files, matching, metadata, profiles, repairs, retrieval  # noqa: F401
from gaugeline.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
