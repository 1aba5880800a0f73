"""Every registered query against its SQL on the smallest data."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from __spark_entry__ import entry, queries  # noqa: E402
from check_oracle import TABLES, compare  # noqa: E402
from skirmish.catalog import oracle  # noqa: E402
from skirmish.catalog.queries import QUERIES, r6  # noqa: E402
from skirmish.schema import TABLES as SPECS  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test data")
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in TABLES:
        c.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(oracle.oracle_sql()) == set(QUERIES) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == SPECS["fight_sides"].names


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    line = compare(spark, con, name, queries()[name], SQL[name], SF)
    assert line.startswith("ok"), line


def test_doubles_next_to_a_half_are_rounded_as_in_sql(spark):
    values = [0.012262499999999999, 0.23906249999999996, 0.2390625, 0.0078125, -0.012262499999999999, 1e-9, 2.0, 1e300, float("inf")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(r6("v")).collect()]
    assert got == [duckdb.execute("select round(?::double, 6)", [v]).fetchall()[0][0] for v in values]
    assert got[0] == 0.012263  # the product with 1e6 is a half, the double itself is less
