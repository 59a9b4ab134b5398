"""Column names that operators add for their own use."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(stem: str, *frames: DataFrame) -> str:
    """A column name that no frame has, whatever its letters' case; `stem` itself where it is free."""
    taken = {c.lower() for f in frames for c in f.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
