"""Queries and their SQL twins."""

from colligo.plans import albums, grouping, judging, ledger, merge, quota, scan, scoring, verdict  # noqa: F401
from colligo.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
