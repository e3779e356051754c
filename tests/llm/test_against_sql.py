"""Queries whose rows SQL can give."""

import pytest
from helpers import DATA, assert_same

from lodestone.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert_same(registry.QUERIES[name](spark, DATA), duck, registry.ORACLE_SQL[name])
