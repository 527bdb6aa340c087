"""Every registered query of the retrieval operators against its SQL, run by DuckDB on the same tables."""

import decimal

import duckdb
import pytest

from trovespark.plans import catalogue
from trovespark.sources.tables import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(float(v) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    result = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in result.description]
    want = sorted(tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True))) for r in result.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows_only(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
