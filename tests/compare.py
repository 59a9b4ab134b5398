"""Hold a Spark result against DuckDB's: column names, kinds of types, and rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    return value


def rows(names: list[str], data) -> list[tuple]:
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    expected = con.execute(sql)
    names = [c[0] for c in expected.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, expected.fetchall())


def type_names(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[tuple[str, str, str]]:
    """Columns whose types differ in kind: (name, Spark's, DuckDB's)."""
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "array<float>": "FLOAT[]", "array<bigint>": "BIGINT[]", "array<string>": "VARCHAR[]"}
    found = {c[0]: str(c[1]) for c in con.execute(sql).description}
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [(n, t, described.get(n, found.get(n, ""))) for n, t in df.dtypes if kinds.get(t) != described.get(n)]
