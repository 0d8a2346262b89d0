"""Registered queries of the library over the driver's tables, and the SQL that checks them."""

from leadweave.plans import ingest, leads, market, measure, resolution  # noqa: F401
from leadweave.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
