"""Every registered query against its reference SQL on the smallest tables."""

import duckdb
import pytest

from checks import ORACLES, QUERIES
from checks.compare import TABLES, normal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_reference_sql(spark, con, name):
    mine = QUERIES[name](spark, SF).toPandas()
    theirs = con.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert normal(mine) == normal(theirs)


def test_every_query_has_reference_sql():
    assert set(QUERIES) == set(ORACLES)
