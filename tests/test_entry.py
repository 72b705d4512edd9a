import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from factloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame):
    shown = lambda v: "null" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        expected = duck.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)
    else:
        assert len(got)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
