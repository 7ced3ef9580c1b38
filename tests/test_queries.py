import pytest
from oracle import same

from conftest import SF
from factloom.plans import core, core_sql


@pytest.mark.parametrize("name", sorted(core_sql.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, SF, core.queries()[name], core_sql.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core_sql.oracle_sql())))
def test_query_runs(spark, name):
    core.queries()[name](spark, SF).count()


def test_entry(spark):
    import __spark_entry__ as e

    assert "relation" in e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
