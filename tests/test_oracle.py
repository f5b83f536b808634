"""Every named query and every check against independent SQL."""

import pytest

import __spark_entry__ as contract
from orderlens.plans.catalog import CATALOG
from orderlens.plans.checks import CHECKS
from tests.conftest import SF
from tests.oracle_check import compare

ORACLE = contract.oracle_sql()
QUERIES = {name: query for name, query in contract.queries().items() if name in CATALOG or name in CHECKS}


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, name):
    """Same values as the SQL, and no cross join or Python in the plan."""
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "ExistingRDD"):
        assert unwanted not in plan
    assert compare(df, SF, ORACLE[name]) is None


def test_entry_has_rows(spark):
    out = contract.entry(spark)
    assert out.columns[0] == "segment" and out.count() > 0
