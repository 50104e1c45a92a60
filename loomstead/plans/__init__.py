"""The queries over the driver's tables, each with the SQL that it is held against."""

from loomstead.plans import cleaning, details, exports, ingest, lookups, people, reports, search, streams, upkeep
from loomstead.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cleaning", "details", "exports", "ingest", "lookups", "people", "reports", "search", "streams", "upkeep"]
