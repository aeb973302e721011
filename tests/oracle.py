"""Comparison of a query with its SQL on DuckDB: columns by name, rows in any order."""

from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return repr(v) if isinstance(v, float) else None if v is None else str(v)


def compare(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    names = list(rel.columns)
    assert sorted(names) == columns
    want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert got == want
