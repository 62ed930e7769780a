"""Runs a query and its SQL side by side, as the driver does."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows(table, columns):
    def plain(v):
        return tuple(v) if isinstance(v, list) else v

    data = table.select(columns).to_pydict()
    return sorted(zip(*([plain(v) for v in data[c]] for c in columns)), key=repr)


def assert_same(query, sql, spark, con, sf_dir):
    got, want = query(spark, sf_dir).toArrow(), con.sql(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    columns = sorted(got.column_names)
    a, b = rows(got, columns), rows(want, columns)
    assert len(a) == len(b)
    different = [(x, y) for x, y in zip(a, b) if x != y]
    assert not different, different[:3]
