"""All queries and their SQL, by name."""

from rondo.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
