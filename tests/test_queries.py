"""Every query with SQL, against that SQL in another engine."""

import pytest

import compare
from loamline import plans

plans.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_rows_match_sql(spark, sf_dir, con, name):
    assert compare.difference(spark, con, plans.QUERIES[name], plans.ORACLES[name], sf_dir) == ""


def test_hot_plans_run_no_python(spark, sf_dir):
    for name in ("ag1_feature_metrics", "jn3_co_change_pairs", "jn5_range_coverage", "fn10_layers"):
        plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert "ReadSchema: struct<p_partkey" in plans.QUERIES["ag12_test_files"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
