"""Every bound query against its SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tallyforge import bindings


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(9)
        df[c] = df[c].astype(str).replace({"None": "-", "nan": "-", "<NA>": "-"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(bindings.ORACLE_SQL))
def test_against_sql(name, spark, sf, duck):
    got, want = plain(bindings.QUERIES[name](spark, sf).toPandas()), plain(duck.sql(bindings.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want), got.merge(want, how="outer", indicator=True).query("_merge != 'both'").head()
