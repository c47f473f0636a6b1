import pytest
from oracle import SF, same

from tideline.plans import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 8
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
