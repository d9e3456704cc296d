"""Spark result against SQL result: same columns, same rows in any order."""

import datetime
import glob
import math
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, "nan") if math.isnan(v) else (2, repr(v + 0.0))
    if isinstance(v, int):
        return (3, str(v))
    if isinstance(v, datetime.datetime):
        return (4, v.replace(tzinfo=None).isoformat())
    return (5, str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    rel = con.sql(sql)
    return rows_of(rel.columns, rel.fetchall())


def difference(con, sql, df):
    cs, rs = spark_rows(df)
    cd, rd = sql_rows(con, sql)
    if cs != cd:
        return f"columns {cs} != {cd}"
    if len(rs) != len(rd):
        return f"rows {len(rs)} != {len(rd)}"
    bad = [(a, b) for a, b in zip(rs, rd) if a != b]
    return f"{len(bad)} of {len(rs)} rows differ, first: {bad[0]}" if bad else None
