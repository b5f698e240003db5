"""Every registered query against its SQL, and the smaller operators against literals."""

import pytest

from tessera.plans import catalog

from . import oracle

SF = "/root/testdata/sf0.01"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert oracle.difference(spark, con, SF, catalog.queries()[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
