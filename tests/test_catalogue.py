import pytest
from compare import assert_same, connect

from imgspark import catalogue

SF = "/root/testdata/sf0.001"
ORACLE = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, con):
    assert_same(catalogue.queries()[name], ORACLE[name], spark, con, SF)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["img_id", "y", "x", "c", "v"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_shuffle_for_points(spark):
    """Point operators of a scan plan no exchange; a separable window plans one."""
    from imgspark import fixtures
    from imgspark.operators import pixels as P

    plan = P.threshold(fixtures.gray8(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plan = P.erode(fixtures.gray8(spark, SF), 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
