"""Comparison of a query with its SQL in DuckDB, as bags of rows with columns by name."""

import datetime
import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 5)
    if hasattr(value, "asDict"):
        value = list(value)
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([plain(row[i]) for i in order]) for row in rows)


def same(frame, con, sql):
    result = con.execute(sql)
    expected = bag([d[0] for d in result.description], result.fetchall())
    assert bag(frame.columns, frame.collect()) == expected
