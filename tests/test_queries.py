import pytest

import __spark_entry__ as registered
from tabscope.plans.catalog import catalog
from tabscope.plans.oracle import oracle
from tests.compare import connection, difference

QUERIES, SQL = catalog(), oracle()


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, sf, duck, name):
    assert difference(spark, sf, name, QUERIES[name], SQL[name], duck) is None


def test_entry(spark):
    assert registered.entry(spark).count() == 11


def test_filters_and_columns_reach_the_files(spark, sf):
    from tabscope.operators.series import group_sum

    lineitem = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_shipdate < '1996-01-01'")
    plan = group_sum(lineitem, "l_returnflag", "l_quantity")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan
    assert "LessThan(l_shipdate" in plan and "TakeOrderedAndProject" in plan
