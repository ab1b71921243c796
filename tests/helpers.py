from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "none" if value != value else f"{value:.6f}"
    if value is None or value is pd.NA or value is pd.NaT:
        return "none"
    if hasattr(value, "__len__") and not isinstance(value, str):
        return str([plain(v) for v in value])
    return str(value)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


def against_sql(spark, query, sql: str, folder: str = SMALL) -> None:
    con = duckdb.connect()
    for file in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(file)[:-8]} as select * from '{file}'")
    relation = con.execute(sql)
    expected = relation.fetch_df() if hasattr(relation, "fetch_df") else relation.df()
    got = query(spark, folder).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
