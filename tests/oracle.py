"""Compares a query's rows with its SQL's in DuckDB: names, row count and values, in any order."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.7g}" if isinstance(v, float) else str(v)


def differences(df, con, sql: str) -> str:
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in res.fetchall())
    mine = sorted(tuple(plain(r[c]) for c in order) for r in df.select(*[f"`{c}`" for c in order]).collect())
    if mine == theirs:
        return ""
    a, b = set(mine) - set(theirs), set(theirs) - set(mine)
    return f"{len(mine)} and {len(theirs)} rows; only here {sorted(a)[:3]}; only there {sorted(b)[:3]}"
