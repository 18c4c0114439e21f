"""Previews on standard output."""

from __future__ import annotations

from pyspark.sql import DataFrame


def show_stages(rows: int = 20, **stages: DataFrame) -> None:
    """Print the first rows of each stage in full width, under its name."""
    for name, df in stages.items():
        print(f"=== {name} ===")
        df.show(rows, truncate=False)
