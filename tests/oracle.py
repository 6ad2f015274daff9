"""Rows of a Spark result and of DuckDB's, made comparable."""

import datetime
import glob
import math
import os

import duckdb
import numpy as np


def plain(v):
    if v is None or (isinstance(v, (float, np.floating)) and math.isnan(v)):
        return None
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    if isinstance(v, (np.integer, np.bool_)):
        return v.item()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.select(*names).collect()), key=repr)


def duck_rows(sf_dir, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        part = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {os.path.basename(f).split('.')[0]} AS SELECT * FROM '{part}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
