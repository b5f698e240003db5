"""Compare registered queries with their SQL run by DuckDB on the same files."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "isoformat"):
        return str(value).replace("T", " ")[:26]
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else value
    return value if isinstance(value, (int, str, bool)) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    have = df.collect()
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.columns, have), rows_of(names, found.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}" if wrong else None
