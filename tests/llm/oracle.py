"""Runs a query and its SQL over the same tables and compares them as the driver does: columns by name, rows in any order."""

import glob
import os

import duckdb


def same(spark, name, query, sql, sf_dir):
    got = query(spark, sf_dir)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns, (name, names, columns)
    rows = [tuple(r[names.index(c)] for c in columns) for r in want.fetchall()]
    shown = lambda rows: sorted(map(repr, rows))
    assert shown(tuple(r[c] for c in columns) for r in got.collect()) == shown(rows), name
    return len(rows)
