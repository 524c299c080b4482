"""Queries that run the operators on the test tables.

Each query has a Spark plan and, where SQL can say it, the SQL it must equal.
"""

from . import coverage, geometry, ingest, marts, panel, survey  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
