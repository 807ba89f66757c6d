"""Compares a Spark result with a DuckDB one: columns by name, rows in any order, floats to four digits."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)

    def plain(x):
        if x is None or x != x:
            return None
        return round(float(x), 4) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=str)


def assert_same(spark_df, sql, sf_dir):
    ours, theirs = spark_df.toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
