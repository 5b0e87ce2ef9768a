"""Run one catalog query in Spark and its SQL twin in DuckDB and compare the values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else value
    return value


def key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(norm(r[n]) for n in names) for r in df.collect()), key=key)


def sql_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    return [cols[i] for i in order], sorted(rows, key=key)


def differences(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    names, got = spark_rows(df)
    wanted_names, wanted = sql_rows(con, sql)
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if len(got) != len(wanted):
        return f"rows {len(got)} != {len(wanted)}\n  spark {got[:2]}\n  sql   {wanted[:2]}"
    bad = [(g, w) for g, w in zip(got, wanted) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first:\n  {names}\n  spark {bad[0][0]}\n  sql   {bad[0][1]}"
    kinds = lambda rows: [{type(v).__name__ for v in col if v is not None} for col in zip(*rows)]
    for n, a, b in zip(names, kinds(got), kinds(wanted)):
        if a != b:
            return f"type of {n}: spark {a} sql {b}"
    return None
