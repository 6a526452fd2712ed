"""Compares a query's rows with those of its DuckDB SQL, column by name, without regard to order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differences(spark_df, con, sql: str) -> str:
    mine = spark_df.toPandas()
    theirs = con.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} {sorted(theirs.columns)}"
    names = sorted(mine.columns)
    a = mine[names].astype(object).where(mine[names].notna(), None)
    b = theirs[names].astype(object).where(theirs[names].notna(), None)
    rows = lambda d: sorted(tuple(map(str, r)) for r in d.itertuples(index=False, name=None))
    x, y = rows(a), rows(b)
    if x == y:
        return ""
    off = [(p, q) for p, q in zip(x, y, strict=False) if p != q][:2]
    return f"{len(x)} and {len(y)} rows; first differences {off}"
