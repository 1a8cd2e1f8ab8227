"""Every catalogued query with oracle SQL equals DuckDB on sf0.001 (whole tables)."""

import os

import duckdb
import pytest

from tools.oracle_check import TABLES, digest, type_mismatches

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def _names():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    frame = E.queries()[name](spark, SF)
    sdf = frame.toPandas()
    ddf = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sdf.columns) == sorted(ddf.columns)
    assert type_mismatches(frame, con.sql(E.oracle_sql()[name])) == {}
    assert len(sdf) == len(ddf)
    assert digest(sdf) == digest(ddf)


def test_every_query_has_a_callable():
    import __spark_entry__ as E
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 60
