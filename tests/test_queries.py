import pytest

from gridlore.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    from gridlore.operators import live
    from gridlore.views import Views

    plan = live.of_district(Views(spark, sf).outages, "girne")._jdf.queryExecution().toString()
    assert "ReadSchema" in plan and "props" not in plan.split("ReadSchema")[-1]
