"""Registered queries over the given tables and the SQL they are checked against."""

from pubmetrics.checks.oracle import ORACLES
from pubmetrics.checks.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
