"""Runs a registered query and its SQL side by side, as the correctness gate does."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "is_integer") or type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def oracle(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    found = con.sql(sql)
    return sorted(found.columns), rows_of(found.columns, found.fetchall())


def ours(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])
