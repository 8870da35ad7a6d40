"""Comparison of a query with its DuckDB statement, columns by name and rows in any order."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    base = duckdb.connect()
    for path in sorted(Path(folder).iterdir()):
        source = path / "*.parquet" if path.is_dir() else path
        base.execute(f"CREATE VIEW {path.name.split('.')[0]} AS SELECT * FROM '{source}'")
    return base


def same(df, base: duckdb.DuckDBPyConnection, statement: str) -> None:
    columns = sorted(df.columns)
    result = base.execute(statement)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    key = lambda row: tuple("null" if v is None else str(v) for v in row)
    expected = Counter(key([row[names.index(c)] for c in columns]) for row in result.fetchall())
    found = Counter(key(row) for row in df.select(*columns).collect())
    assert found == expected, (list((expected - found))[:3], list((found - expected))[:3])
