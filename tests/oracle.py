"""Comparing a query with its SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb

FOLDER = "/root/testdata/sf0.001"


def _text(x):
    if isinstance(x, float):
        return f"{x:.6f}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_text, x)) + "]"
    if isinstance(x, dict):
        return _text(list(x.values()))
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter("|".join(_text(r[i]) for i in order) for r in rows)


def compare(spark, query, sql, folder=FOLDER):
    df = query(spark, folder)
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())
