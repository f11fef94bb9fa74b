"""Bindings of the operators to the test tables, with the same question in SQL."""

from assayspark.catalog import experiments, learning, rows, screening, tables  # noqa: F401
from assayspark.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
