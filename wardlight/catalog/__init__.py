"""Registered queries. Importing the package fills the registry."""

from wardlight.catalog import encounters, growing, hospital, learning, scoring
from wardlight.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "encounters", "growing", "hospital", "learning", "scoring"]
