"""Each footage query against its DuckDB SQL: row count, columns and values."""

import duckdb
import pytest

from rushes.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def rows(frame):
    import pandas as pd

    out = []
    for record in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple("null" if pd.isna(v) else f"{float(v):.5f}" if isinstance(v, (float, int)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v) for v in record))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)


def test_same_names():
    assert set(ORACLES) <= set(QUERIES)
