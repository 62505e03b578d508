"""Run a query and its SQL on the same tables and compare the rows."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    if hasattr(x, "as_tuple"):
        return round(float(x), 5)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


def differences(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = rows([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"{name}: columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{name}: {len(got[1])} rows and {len(want[1])}: {got[1][:3]} and {want[1][:3]}"
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{name}: {len(bad)} of {len(got[1])} rows differ: {bad[:3]}" if bad else None
