"""All queries of this subpackage and of the pipeline over it."""

from murmur.llm import audits, queries  # noqa: F401
from murmur.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
