"""All registered queries."""

from murmur.plans import latest, posts, sentiment, signals, storage, streams, trends, views  # noqa: F401
from murmur.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
