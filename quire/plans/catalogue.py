"""Imports every module that registers queries."""

from quire.plans import ingestion, layouts, library, searches, structures, texts
from quire.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "ingestion", "layouts", "library", "searches", "structures", "texts"]
