"""The registered corpus queries against their SQL."""

import pytest

from tests import oracle
from tessera.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert oracle.difference(spark, oracle.connect(SF), SF, registry.queries()[name], registry.oracle_sql()[name]) is None
