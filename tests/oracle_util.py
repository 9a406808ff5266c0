"""Shared compare: Spark rows vs DuckDB rows, order-insensitive."""

import duckdb

from pnlbook.sources.tables import TABLES, table_path


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("\\N" if r[i] is None else str(r[i]) for i in order) for r in rows)


def same(df, con, sql):
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    rows = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert canon(df.columns, rows) == canon(ocols, orows)
    return rows
