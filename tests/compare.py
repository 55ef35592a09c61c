"""Rows of a Spark query against rows of SQL over the same files."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def sql_rows(sql, data=DATA):
    con = duckdb.connect()
    for name in os.listdir(data):
        path = f"{data}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.sql(sql)
    return found.columns, found.fetchall()


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, sql, data=DATA):
    columns, rows = sql_rows(sql, data)
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, rows)
