import pytest
from oracle import same

from conftest import SF
from factloom.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_found_equals_sql(spark, name):
    same(spark, SF, queries.queries()[name], sql.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql()) - {"p1_nearest", "p1_search"}))
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
