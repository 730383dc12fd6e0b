"""Runs a query and its SQL side by side."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def compared(df, con, sql: str):
    """(rows of the query, rows of the SQL), columns by name, sorted."""
    names = sorted(df.columns)
    rel = con.execute(sql)
    theirs = [d[0] for d in rel.description]
    assert sorted(theirs) == names, (names, theirs)
    order = [theirs.index(n) for n in names]
    want = sorted(repr(tuple(row[i] for i in order)) for row in rel.fetchall())
    got = sorted(repr(tuple(r[n] for n in names)) for r in df.select(*names).collect())
    return got, want
