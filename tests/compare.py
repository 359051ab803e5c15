"""Spark result against DuckDB result: columns by name, rows in any order."""

import datetime
import decimal
import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) and glob.glob(f"{p}/*.parquet") else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def differences(df, con, sql: str) -> str:
    """Empty if both hold the same rows."""
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    theirs_names = [d[0] for d in cur.description]
    if sorted(theirs_names) != names:
        return f"columns {names} against {sorted(theirs_names)}"
    at = [theirs_names.index(n) for n in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if mine != theirs:
        a, b = [r for r in mine if r not in set(theirs)][:2], [r for r in theirs if r not in set(mine)][:2]
        return f"{len(mine)} rows against {len(theirs)}; {names}: {a} against {b}"
    return ""
