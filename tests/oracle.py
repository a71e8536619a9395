"""Comparison of a query with its SQL over the small tables."""

from __future__ import annotations

import functools

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@functools.cache
def database(folder: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def same(spark_df, sql: str, folder: str = SF) -> None:
    ours, theirs = spark_df.toPandas(), database(folder).sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    columns = sorted(ours.columns)
    key = [c for c in columns if ours[c].dtype != float] or columns
    ours, theirs = (x[columns].sort_values(key).reset_index(drop=True) for x in (ours, theirs))
    for c in columns:
        if ours[c].dtype == float:
            gap = (ours[c].fillna(-1e300) - theirs[c].astype(float).fillna(-1e300)).abs()
            assert gap.max() <= 2e-6 if len(gap) else True, c
        else:
            assert ours[c].fillna("~").astype(str).tolist() == theirs[c].fillna("~").astype(str).tolist(), c
