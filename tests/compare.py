"""Runs registered queries and their SQL on the same tables and compares the rows."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def kinds(rows, n):
    return [{type(plain(r[i])).__name__ for r in rows} - {"NoneType"} for i in range(n)]


def differences(spark, con, sf_dir, run, sql):
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    found = con.execute(sql)
    theirs = [d[0] for d in found.description]
    if sorted(theirs) != names:
        return f"columns {names} against {sorted(theirs)}"
    at = [theirs.index(n) for n in names]
    want = [tuple(r[i] for i in at) for r in found.fetchall()]
    a, b = (Counter(tuple(map(plain, r)) for r in rows) for rows in (got, want))
    if a != b:
        return f"{len(got)} rows against {len(want)}; only here {list((a - b).items())[:3]}; only there {list((b - a).items())[:3]}"
    for n, x, y in zip(names, kinds(got, len(names)), kinds(want, len(names))):
        if x != y:
            return f"{n} is {x} against {y}"
    return ""
