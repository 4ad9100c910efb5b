"""Compare a query with its oracle in DuckDB: rows as multisets, columns by name."""

import math
import os

import duckdb


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return int(x) if x == int(x) else round(x, 9)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    found = con.sql(sql)
    return rows_of(found.columns, found.fetchall())


def assert_same(df, sql, sf_dir):
    names, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    expected_names, expected = oracle_rows(sql, sf_dir)
    assert names == expected_names
    assert len(rows) == len(expected)
    differ = [(a, b) for a, b in zip(rows, expected, strict=True) if a != b]
    assert not differ, differ[:3]
