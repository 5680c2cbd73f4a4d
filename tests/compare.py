"""Strict comparison of a Spark result with a DuckDB result: names, kinds, row multiset, exact values."""

from __future__ import annotations

import collections
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{Path(sf_dir) / (name + '.parquet')}')")
    return con


def normal(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return ("float", repr(v))
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, str):
        return ("str", v)
    return (type(v).__name__, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], collections.Counter(tuple(normal(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql) -> str | None:
    cur = con.execute(sql)
    o_cols = [d[0] for d in cur.description]
    o_names, o_rows = rows_of(o_cols, cur.fetchall())
    s_names, s_rows = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if s_names != o_names:
        return f"columns {s_names} against {o_names}"
    n_s, n_o = sum(s_rows.values()), sum(o_rows.values())
    if n_s != n_o:
        return f"rows {n_s} against {n_o}"
    if n_s == 0:
        return "both results are empty"
    only_s, only_o = list((s_rows - o_rows).elements()), list((o_rows - s_rows).elements())
    if only_s or only_o:
        key = lambda r: tuple(str(x) for x in r)
        return f"{len(only_s)} of {n_s} rows differ, columns {s_names}\n  spark {sorted(only_s, key=key)[:3]}\n  oracle {sorted(only_o, key=key)[:3]}"
    return None
