"""Compares a registered query with its SQL on DuckDB."""

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(str).values.tolist()))


def same(df, sql, con):
    got, expected = df.toPandas(), con.execute(sql).df()
    assert rows(got) == rows(expected)
