"""Runs a query's SQL in DuckDB and compares it with Spark's rows, whatever their order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else f"{v:.9g}"
    return None if v is None else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(tuple(repr(plain(r[k])) for k in order) for r in rows)


def compare(df, sql, sf_dir):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    done = connect(sf_dir).execute(sql)
    want = rows_of([d[0] for d in done.description], done.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
    return len(got[1])
