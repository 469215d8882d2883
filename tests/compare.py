"""Rows of Spark and DuckDB in one comparable form."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.11g}")
    return v


def shaped(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


def spark_rows(df):
    t = df.toArrow()
    return shaped(t.column_names, list(zip(*[c.to_pylist() for c in t.columns], strict=True)) if t.num_rows else [])


def duck_rows(sql, sf_dir=None, **tables):
    con = duckdb.connect()
    for t in TABLES if sf_dir else ():
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    for name, arrow in tables.items():
        con.register(name, arrow)
    c = con.execute(sql)
    return shaped([x[0] for x in c.description], c.fetchall())
