"""Runs a registered query on Spark and its SQL on DuckDB and compares the rows."""

import glob
import math
import os

import duckdb


def _plain(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{_plain(v)}" for k, v in value.items()) + "}"
    return str(value)


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())


def duck_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), rows_of(columns, cursor.fetchall())


def difference(df, con, sql):
    """None when equal, else a short text on what differs."""
    left_cols, left = spark_rows(df)
    right_cols, right = duck_rows(con, sql)
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}"
    if left == right:
        return None
    only_left = [r for r in left if r not in set(right)][:2]
    only_right = [r for r in right if r not in set(left)][:2]
    return f"rows {len(left)} / {len(right)}; only Spark {only_left}; only SQL {only_right}"
