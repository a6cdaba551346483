"""Rows of a query against rows of DuckDB SQL over the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return "NULL" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
    return str(v)


def same_rows(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in cur.fetchall())
    got = sorted(tuple(plain(v) for _, v in sorted(r.asDict().items())) for r in df.collect())
    assert got == expected
