"""Compare a catalog query with its SQL twin on the same parquet tables."""

import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(row[i]) for i in order) for row in rows)


def compare(spark, sf_dir, name, fn, sql, con):
    start = time.time()
    df = fn(spark, sf_dir)
    got = canonical(df.columns, df.collect())
    took = time.time() - start
    result = con.execute(sql)
    want = canonical([d[0] for d in result.description], result.fetchall())
    return got == want, len(got[1]), len(want[1]), took, got, want
