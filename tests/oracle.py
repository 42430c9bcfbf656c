"""Runs a query in Spark and its SQL in DuckDB on the same tables and compares the rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in rows)


def assert_same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    theirs = connect(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(theirs.columns)
    assert ours == rows_of(theirs.columns, theirs.fetchall())
