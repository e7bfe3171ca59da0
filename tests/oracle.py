"""Compares a query with its SQL on DuckDB."""

import math
from pathlib import Path

import duckdb


def shown(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    try:
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    except (TypeError, ValueError):
        return str(v)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(df, con, sql):
    cols = sorted(df.columns)
    ours = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert cols == sorted(names)
    theirs = sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
