"""Every registered query of the event operators against its SQL on DuckDB, over the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidewatch.plans.registry import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def norm(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return str(v) if isinstance(v, pd.Timestamp) else v


def rows(df, columns):
    return sorted(repr(tuple(map(norm, r))) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, data, name):
    a, b = QUERIES[name](spark, data).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["count", "source_ip", "user"]
    assert set(ORACLE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
