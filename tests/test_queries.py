"""Every query with an oracle gives what DuckDB gives."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple("null" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r))
    return sorted(out)


@pytest.fixture(scope="module")
def duck(sf):
    import os

    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas().astype(object)
    want = duck.sql(ORACLES[name]).df().astype(object)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_the_flagship_runs(spark):
    assert entry.entry(spark).count() == 200
