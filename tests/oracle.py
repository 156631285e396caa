"""Compare a query with its SQL by rows, in any order, over the same parquet files."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v.item() if hasattr(v, "item") else v


def same_rows(df, con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in df.columns]
    want = sorted(repr(tuple(_plain(r[i]) for i in at)) for r in got.fetchall())
    have = sorted(repr(tuple(_plain(v) for v in r)) for r in df.collect())
    assert have == want
