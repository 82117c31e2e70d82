"""Rows of a query and of its SQL in one form."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value) -> str:
    if isinstance(value, float):
        return repr(value + 0.0)
    return "NULL" if value is None else str(value)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def sql_rows(con, sql: str):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    return columns, sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
