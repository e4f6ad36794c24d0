"""Compare a query with its SQL as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_key(r[i]) for i in order) for r in data), key=repr)


def compare(df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    cursor = con.execute(sql)
    names, expected = rows([d[0] for d in cursor.description], cursor.fetchall())
    own, got = rows(df.columns, [tuple(r) for r in df.collect()])
    if own != names:
        return f"columns {own} != {names}"
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}"
    bad = [(a, b) for a, b in zip(got, expected, strict=True) if a != b]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else ""
