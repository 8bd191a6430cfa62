import pytest

from docloom.llm import registry
from tests.compare import connect, same

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert same(spark, connect(DIR), registry.queries()[name], registry.oracle_sql()[name], DIR)
