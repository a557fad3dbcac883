"""Order-free comparison of a Spark result with the SQL result."""

from __future__ import annotations

import datetime
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def _cell(x):
    if isinstance(x, float):
        return repr(x)
    if isinstance(x, datetime.datetime):
        return x.isoformat(" ")
    return str(x)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def sql_table(con, sql):
    cur = con.execute(sql)
    return table([d[0] for d in cur.description], cur.fetchall())


# Spark type names and what the SQL engine calls them.
SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP",
    "date": "DATE", "boolean": "BOOLEAN",
}


def type_difference(df, con, sql) -> str:
    want = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    got = {n: SAME_TYPE.get(t, t) for n, t in df.dtypes}
    return ", ".join(f"{n}: {got[n]} is not {want[n]}" for n in sorted(got) if n in want and got[n] != want[n])


def difference(df, con, sql) -> str:
    """'' when equal, otherwise what differs."""
    names, rows = spark_table(df)
    want_names, want = sql_table(con, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(rows) != len(want):
        return f"rows {len(rows)} != {len(want)}"
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    return f"{len(bad)} of {len(rows)} rows differ, first: {bad[0]}" if bad else type_difference(df, con, sql)
