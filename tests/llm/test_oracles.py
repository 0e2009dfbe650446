import pytest

from tests.conftest import same_rows
from threatloom.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    same_rows(Q.queries()[name](spark, small), Q.oracle_sql()[name], small)
