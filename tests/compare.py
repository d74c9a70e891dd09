"""Rows of a Spark query beside the rows of its SQL in DuckDB."""

import os
from decimal import Decimal
from math import isnan

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and isnan(v):
        return "~"
    if isinstance(v, (list, tuple)):
        return f"[{', '.join(map(plain, v))}]"
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.9g}"
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


def table_of(names, rows):
    """Rows as text, columns in the order of their names, sorted."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([plain(r[i]) for i in order] for r in rows)


def spark_rows(df):
    return table_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    got = con.execute(sql)
    return table_of([c[0] for c in got.description], got.fetchall())
