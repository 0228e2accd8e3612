"""Spark's rows against DuckDB's."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    clean = lambda x: None if x is None or x is pd.NA or x != x else (float(x) if isinstance(x, float) else x)
    return sorted(([clean(v) for v in r] for r in df.astype(object).itertuples(index=False)), key=str)


def same(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> None:
    assert sorted(spark_df.columns) == sorted(duck_df.columns)
    assert len(spark_df) == len(duck_df)
    assert canonical(spark_df) == canonical(duck_df)
