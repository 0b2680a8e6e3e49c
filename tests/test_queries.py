import duckdb
import pandas as pd
import pytest

from bitweave.plans import catalogue, oracle

DATA = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("lineitem", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(SQL) == set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    a, b = catalogue.queries()[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    cols = sorted(a.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=1e-9)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
