"""Spark-native screening, profiling and modelling of wide numeric tables."""

from assayspark.roles import TableRoles
from assayspark.session import build_session

__all__ = ["TableRoles", "build_session"]
