"""Spark results against DuckDB over the same tables, columns sorted by name and rows in any order."""

import math

import duckdb
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


def differences(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*(F.col(f"`{c}`") for c in names)).collect())
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    order = sorted(range(len(columns)), key=columns.__getitem__)
    want = sorted(tuple(plain(r[k]) for k in order) for r in cur.fetchall())
    more, less = set(got) - set(want), set(want) - set(got)
    return sorted(more)[:3], sorted(less)[:3], len(got), len(want)
