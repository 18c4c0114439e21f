"""Murmur: social-post signal analytics written on the public Spark APIs.

The package turns raw short posts into per-symbol trend, spike and sentiment
tables.  Everything is a ``DataFrame -> DataFrame`` function, so the same code
serves batch jobs and Structured Streaming wherever Spark allows it.
"""

__version__ = "0.1.0"
