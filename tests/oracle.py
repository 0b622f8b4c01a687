"""Compare a query with its DuckDB SQL on the driver's tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(round(float(v), 6) if isinstance(v, float) else None if v is None else str(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=str)


def check(spark, query, sql, sf_dir):
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
