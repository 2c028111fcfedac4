"""A Spark result against DuckDB's, as rows in any order, columns by name."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def key(row):
    return tuple((x is None, str(x)) for x in row)


def same(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    arrow = con.execute(sql).fetch_arrow_table() if hasattr(con.execute("select 1"), "fetch_arrow_table") else con.execute(sql).to_arrow_table()
    assert sorted(arrow.column_names) == cols, (arrow.column_names, cols)
    want = sorted((tuple(plain(r[c]) for c in cols) for r in arrow.to_pylist()), key=key)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want):
        assert g == w, (g, w)
    return len(got)
