"""Rows of a Spark query against rows of its SQL in another engine."""

import datetime
import math
import os


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}" if x else "0"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return str([value(y) for y in x])
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in data)


def difference(spark, con, f, sql, sf_dir):
    """What differs, or an empty string."""
    df = f(spark, sf_dir)
    got = rows(df.columns, df.collect())
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    want = rows(names, res.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        a, b = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        return f"{len(got)} and {len(want)} rows; only Spark {a}; only SQL {b}"
    return ""
