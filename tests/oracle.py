"""Compare a DataFrame with the rows of DuckDB SQL over the same tables, whatever their order."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return x
    return round(float(x), 6) if isinstance(x, (int, float)) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([_plain(x) for x in r]) for r in frame.astype(object).itertuples(index=False))


def check(con, df, sql):
    got, want = df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b, [*[x for x in a if x not in b][:5], "|", *[x for x in b if x not in a][:5]]
