"""Rows of a query and of its SQL twin in DuckDB, made comparable."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def comparable(rows, columns):
    value = lambda v: str(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(value(r[c]) for c in columns) for r in rows)


def both(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    return comparable([r.asDict() for r in df.collect()], columns), comparable([dict(zip(names, r)) for r in done.fetchall()], columns)
