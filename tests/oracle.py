"""Compares a Spark result with DuckDB's."""

import math

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf: str = SF) -> pd.DataFrame:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c.execute(sql).fetchdf()


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, str):
        return v
    if isinstance(v, pd.Timestamp):
        return str(v)
    return round(float(v), 4)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(_cell(v) for v in r) for r in df.itertuples(index=False)), key=repr)


def same(spark_df, sql: str, sf: str = SF) -> None:
    a, b = spark_df.toPandas(), duck(sql, sf)
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
