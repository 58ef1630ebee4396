"""Queries over the test tables and their SQL twins."""

from tallyfold.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
