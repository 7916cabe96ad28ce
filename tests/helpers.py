"""Shared by the tests."""

import math
import os


def rows(df, *cols):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def plain(v):
    """A value as both engines write it: NaN as null, rounded numbers, lists for arrays."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


def duck_of(folder):
    """A connection with the folder's tables as views."""
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS FROM '{folder}/{f}'")
    return con


def same_rows(got, con, sql):
    """Fail unless a frame has the columns and the rows that the SQL gives."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: repr([plain(x) for x in r])
    assert sorted(map(key, got.select(*[f"`{c}`" for c in names]).collect())) == sorted(map(key, rel.fetchall()))
