"""The registry of queries: each has a name, a function of (spark, sf_dir), and SQL for the same rows where SQL can state them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = ("operators.scans", "operators.joins", "operators.aggregates", "operators.sketches", "operators.windows", "operators.ordered", "operators.intervals", "operators.sets", "functions.scalar", "functions.nested", "functions.python", "sources.files", "sources.upsert", "sources.archives", "streaming.replay", "streaming.sinks")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its own name."""

    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"sparkloom.{name}")
