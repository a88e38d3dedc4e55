"""Every query that has SQL against DuckDB on the smallest tables."""

import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

HERE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))


def cell(v) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, numbers.Number) and not isinstance(v, bool | np.bool_):
        return f"{float(v):.7g}"
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([cell(x) for x in v])
    return str(v)[:10] if hasattr(v, "year") else str(v)


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    text = df.apply(lambda c: c.map(cell)).astype(object)
    return text.sort_values(list(text.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{HERE}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(HERE), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    got, wanted = entry.queries()[name](spark, HERE).toPandas(), con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(wanted.columns)
    pd.testing.assert_frame_equal(normal(got), normal(wanted))
